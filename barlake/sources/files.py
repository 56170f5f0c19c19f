"""Bar files: CSV and Parquet drops named `{SYMBOL}_{interval}`, and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators.quality import conform
from barlake.operators.select import in_range
from barlake.schemas import BAR, BAR_COLUMNS

CSV_COLUMNS = ["timestamp", "open", "high", "low", "close", "adj_close", "volume"]


def read_bar_files(
    spark: SparkSession, glob: str, source: str = "sample", start: str | None = None, end: str | None = None
) -> DataFrame:
    """Bars of all matching files at once; symbol and interval come from the file name.

    A file may also be a folder of part files, as Spark writes them; then its name counts (`AAPL_1d.csv/` or `file=AAPL_1d/`).
    """
    csv = glob.endswith(".csv")
    if csv:
        kinds = {f.name: f.dataType.simpleString() for f in BAR.fields}
        schema = ", ".join(f"{c} {kinds[c]}" for c in CSV_COLUMNS)
        raw = spark.read.option("header", True).schema(schema).csv(glob)
    else:
        raw = spark.read.parquet(glob)
    part = F.col("_metadata.file_name").startswith("part-")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:[^/=]+=)?([^/=]+?)(?:\.csv|\.parquet)?/[^/]+$", 1)
    name = F.when(part, folder).otherwise(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.(csv|parquet)$", 1))
    rows = raw.select(
        *[c for c in raw.columns if c not in ("symbol", "source", "interval")],
        F.regexp_extract(name, r"^(.+)_([^_]+)$", 1).alias("symbol"),
        F.regexp_extract(name, r"^(.+)_([^_]+)$", 2).alias("interval"),
        F.lit(source).alias("source"),
    )
    if "ingestion_time" not in rows.columns:
        rows = rows.withColumn("ingestion_time", F.current_timestamp())
    return in_range(conform(rows, BAR_COLUMNS, keep=["interval"]), start, end)


def export_csv(bars: DataFrame, path: str) -> None:
    """Time-ordered CSV of the seven bar columns, one folder per symbol."""
    bars.select("symbol", *CSV_COLUMNS).hint("rebalance", "symbol").sortWithinPartitions("symbol", "timestamp").write.mode("overwrite").option("header", True).partitionBy("symbol").csv(path)
