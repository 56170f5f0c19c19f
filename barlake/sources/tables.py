"""Layer tables: partition layout, upsert, versions, maintenance, logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.operators.quality import conform, keep_last
from barlake.operators.select import in_range, of_symbol

PARTITION = ("symbol", "year", "month")
#: A later landing wins, whatever time its rows carry.
LANDING_ORDER = ("landed_at", "ingestion_time", "batch_seq")


# --- frame level -----------------------------------------------------------------------------------


def with_partition(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumns({"year": F.year(column), "month": F.month(column)})


def with_partition_path(df: DataFrame) -> DataFrame:
    parts = [F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in PARTITION]
    return with_partition(df).withColumn("path", F.concat_ws("/", *parts))


def upsert(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Union with the later arrival of each (symbol, timestamp) kept."""
    return keep_last(existing.unionByName(arriving, allowMissingColumns=True))


def read_bars(df: DataFrame, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a symbol in time order."""
    df = df if symbol is None else of_symbol(df, symbol)
    return in_range(df, start, end).orderBy("symbol", "timestamp")


def as_of_time(log: DataFrame, at: str) -> DataFrame:
    """The table as it was at a time: arrivals up to then, keep-last."""
    return keep_last(log.filter(F.col("ingestion_time") <= F.lit(at).cast("timestamp")))


def as_of_snapshot(log: DataFrame, snapshot_id: int) -> DataFrame:
    return keep_last(log.filter(F.col("batch_seq") <= snapshot_id))


def snapshots(log: DataFrame) -> DataFrame:
    """One row per committed batch, with its parent; the batch list is as short as the commit history."""
    batches = log.groupBy(F.col("batch_seq").alias("snapshot_id")).agg(
        F.max("ingestion_time").alias("committed_at"), F.count(F.lit(1)).alias("rows")
    )
    history = Window.partitionBy(F.lit(0)).orderBy("committed_at", "snapshot_id")
    newest = F.max_by("snapshot_id", F.struct("committed_at", "snapshot_id")).over(Window.partitionBy(F.lit(0)))
    return batches.withColumns(
        {"parent_id": F.lag("snapshot_id").over(history), "is_current": F.col("snapshot_id") == newest}
    )


def expired_snapshots(log: DataFrame, now: str, older_than_days: int = 7) -> DataFrame:
    """Batches older than the limit, except the current one (listed, not removed)."""
    limit = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(older_than_days))
    return snapshots(log).filter((F.col("committed_at") < limit) & ~F.col("is_current"))


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """Rows per layer and symbol; reads the symbol column only."""
    parts = [df.groupBy("symbol").agg(F.count(F.lit(1)).alias("record_count")).withColumn("layer", F.lit(name)) for name, df in layers.items()]
    return reduce(DataFrame.unionByName, parts)


def ingest_summary(frames: Sequence[DataFrame]) -> DataFrame:
    parts = [df.groupBy("source").agg(F.count(F.lit(1)).alias("rows")) for df in frames]
    return reduce(DataFrame.unionByName, parts).groupBy("source").agg(F.sum("rows").alias("rows"))


# --- storage level ---------------------------------------------------------------------------------


BARS = (
    "timestamp timestamp, open double, high double, low double, close double, adj_close double, volume double, source string, "
    "ingestion_time timestamp, symbol string, year int, month int"
)
#: What an arrival in the log has besides.
ARRIVAL = "landed_at timestamp, writer string, batch_seq int"


class Lake:
    """Layer tables under one root folder (local path, or any Hadoop URI such as ``s3a://``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str) -> str:
        return f"{self.root}/{layer}"

    def exists(self, layer: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(layer))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, layer: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows of a layer; symbol and time range become partition filters. A layer without files is empty."""
        empty = self.spark.createDataFrame([], f"{BARS}, {ARRIVAL}" if layer == "bronze_log" else BARS)
        if not self.exists(layer):
            return empty
        try:
            df = self.spark.read.option("basePath", self.path(layer)).parquet(self.path(layer))
        except AnalysisException as error:  # the folder is there, but the last file is gone
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return empty
        df = df if symbol is None else of_symbol(df, symbol)
        ym = F.col("year") * 12 + F.col("month") if {"year", "month"} <= set(df.columns) else None
        for bound, op in ((start, "ge"), (end, "le")):
            if bound is not None and ym is not None:
                edge = F.lit(bound).cast("timestamp")
                limit = F.year(edge) * 12 + F.month(edge)
                df = df.filter(ym >= limit if op == "ge" else ym <= limit)
        return in_range(df, start, end)

    def append(self, layer: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        df.write.mode("append").partitionBy(*partition_by).parquet(self.path(layer))

    def overwrite_partitions(self, layer: str, df: DataFrame, partition_by: Sequence[str] = PARTITION) -> None:
        """Replace only the partitions present in the frame."""
        self._sized(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *partition_by
        ).parquet(self.path(layer))

    @staticmethod
    def _sized(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
        """Rows grouped by target partition; adaptive execution splits large groups over several tasks."""
        return df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, "timestamp")

    # Bronze ----------------------------------------------------------------------------------------

    def append_bronze(self, bars: DataFrame, batch_seq: int, lineage: dict[str, str] | None = None, writer: str = "batch") -> dict[str, int]:
        """Land one batch: every arrival goes to `bronze_log`, the touched partitions of `bronze` are upserted.

        A batch is known by its writer and number, so writers do not replace each other's batches. It has a folder of its
        own in the log, which a rerun replaces as a whole, with the first landing time kept: a retry adds nothing twice,
        leaves nothing behind and does not overtake later batches. Returns the rows received, written (distinct keys) and
        duplicates, and the partitions.
        """
        own = (F.col("writer") == writer) & (F.col("batch_seq") == batch_seq)
        earlier = self.read("bronze_log").filter(own)
        before = earlier.agg(F.min("landed_at")).first()[0]
        if before is not None:
            # noted before the batch is replaced: a run that ends half-way still knows the months which its rows have left
            named = {"writer": F.lit(writer), "batch_seq": F.lit(batch_seq)}
            self.append("bronze_left", earlier.select(*PARTITION).distinct().withColumns(named), ("writer", "batch_seq"))
        landed_at = F.current_timestamp() if before is None else F.lit(before)
        rows = conform(bars).withColumns({"ingestion_time": F.coalesce("ingestion_time", F.current_timestamp()), "landed_at": landed_at})
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        folder = f"{self.path('bronze_log')}/writer={escape(writer)}/batch_seq={batch_seq}"
        self._sized(with_partition(rows), PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            *PARTITION
        ).parquet(folder)
        log = self.read("bronze_log")
        landed = log.filter(own)
        # The log is the source of the current view, so no partition is read while it is rewritten;
        # the semi join on partition columns reads the touched months only.
        touched = self.touched(batch_seq, writer)
        arrivals = log.join(touched, list(PARTITION), "left_semi")
        self.overwrite_partitions("bronze", keep_last(arrivals, order=LANDING_ORDER).drop("writer", "landed_at"))
        if before is not None:
            self.clear_stale("bronze", arrivals.select("symbol", "timestamp"), touched)
        note = {"layer": "bronze", "writer": writer, "batch_seq": str(batch_seq), **(lineage or {})}
        self.log("lineage", landed.groupBy("symbol").agg(F.count(F.lit(1)).alias("records_received")).withColumn(
            "lineage", F.to_json(F.create_map(*[F.lit(x) for kv in note.items() for x in kv]))
        ), str(batch_seq) if writer == "batch" else f"{writer}-{batch_seq}")
        keys = landed.groupBy("symbol", "timestamp", *PARTITION[1:]).agg(F.count(F.lit(1)).alias("n"))
        parts = keys.groupBy(*PARTITION).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
        total = parts.agg(F.sum("n").alias("received"), F.sum("keys").alias("written"), F.count(F.lit(1)).alias("partitions")).first()
        received, written = total["received"] or 0, total["written"] or 0
        return {"received": received, "written": written, "duplicates": received - written, "partitions": total["partitions"]}

    def touched(self, batch_seq: int, writer: str = "batch") -> DataFrame:
        """Partitions that hold rows of a batch, or held some before a rerun of it."""
        own = (F.col("writer") == writer) & (F.col("batch_seq") == batch_seq)
        parts = self.read("bronze_log").filter(own).select(*PARTITION)
        if self.exists("bronze_left"):
            parts = parts.unionByName(self.spark.read.parquet(self.path("bronze_left")).filter(own).select(*PARTITION))
        return parts.distinct()

    def clear_stale(self, layer: str, valid: DataFrame, touched: DataFrame | None = None) -> None:
        """Remove the partitions of a layer (of those touched) that hold no row of `valid` any more."""
        if not self.exists(layer):
            return
        there = self.read(layer).select(*PARTITION).distinct()
        if touched is not None:
            there = there.join(touched.select(*PARTITION).distinct(), list(PARTITION), "left_semi")
        gone = there.join(with_partition(valid).select(*PARTITION).distinct(), list(PARTITION), "left_anti")
        jvm = self.spark._jvm
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in gone.toLocalIterator():
            p = jvm.org.apache.hadoop.fs.Path("/".join([self.path(layer), *[f"{c}={escape(str(row[c]))}" for c in PARTITION]]))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def write_layer(self, layer: str, df: DataFrame) -> None:
        self.overwrite_partitions(layer, with_partition(df))

    # logs ------------------------------------------------------------------------------------------

    def log(self, name: str, df: DataFrame, run_id: str, partition_by: Sequence[str] = ()) -> None:
        """Append run rows; the rows of a repeated run id replace the earlier ones."""
        out = df.withColumns({"run_id": F.lit(run_id), "created_at": F.current_timestamp()})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by, "run_id").parquet(
            self.path(name)
        )

    def read_log(self, name: str) -> DataFrame:
        """Rows of a log; one that was never written is empty."""
        if not self.exists(name):
            return self.spark.createDataFrame([], "symbol string, created_at timestamp, run_id string")
        return self.spark.read.parquet(self.path(name))

    # maintenance -----------------------------------------------------------------------------------

    def compact(self, layer: str, target_rows: int, staging: str) -> None:
        """Rewrite a layer with files of about `target_rows` rows.

        The rewrite goes to `staging` first and is then copied back per partition, so the source is
        never read while it is replaced.
        """
        keys = [c for c in PARTITION if c in self.read(layer).columns]
        for source, target in ((layer, staging), (staging, layer)):
            self._sized(self.read(source), keys).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).option("maxRecordsPerFile", target_rows).partitionBy(*keys).parquet(self.path(target))

    def rollback(self, snapshot_id: int) -> None:
        """Make an older batch current: the view is rebuilt from the arrival log."""
        old = as_of_snapshot(self.read("bronze_log"), snapshot_id)
        self._sized(old, PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*PARTITION).parquet(self.path("bronze"))

    def files(self, layer: str) -> DataFrame:
        """File inventory (path, size, time); file contents are not read. A layer that was never written has no files."""
        if not self.exists(layer):
            return self.spark.createDataFrame([], "path string, length long, modificationTime timestamp")
        return (
            self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .load(self.path(layer)).select("path", "length", "modificationTime")
        )

    def create_table(self, name: str, layer: str) -> None:
        """Catalog table over a layer folder, partitioned by symbol, year and month, zstd."""
        self.spark.sql(
            f"""CREATE TABLE IF NOT EXISTS {name} (timestamp TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE,
            adj_close DOUBLE, volume DOUBLE, source STRING, ingestion_time TIMESTAMP, symbol STRING, year INT, month INT)
            USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (symbol, year, month) LOCATION '{self.path(layer)}'"""
        )
        self.spark.sql(f"MSCK REPAIR TABLE {name}")
