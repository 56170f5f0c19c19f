"""Bar checks, quarantine, keep-last and quality reports.

A key (symbol, timestamp) may hold any number of copies, so nothing here collects or sorts
the rows of one key: keep-last is a max aggregate, and copies are counted, not listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.schemas import BAR_COLUMNS, PRICE_COLUMNS

KEY = ("symbol", "timestamp")
REPORT = ("missing", "invalid_ohlc", "invalid_volume")


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"schema lacks columns: {missing}")


def conform(df: DataFrame, columns: Sequence[str] = BAR_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """Project to the bar schema; values that do not parse become null, symbols upper case."""
    require(df, columns)
    types = dict(df.dtypes)
    out = []
    for c in columns:
        col = F.col(c)
        if c in PRICE_COLUMNS:
            number = col.try_cast(T.DoubleType())
            col = F.when(~F.isnan(number), number)
        elif c in ("timestamp", "ingestion_time"):
            col = col.try_cast(T.TimestampType()) if types[c] == "string" else col.cast("timestamp")
        elif c == "symbol":
            col = F.upper(col.cast("string"))
        else:
            col = col.cast("string")
        out.append(col.alias(c))
    return df.select(*out, *keep)


def valid_prices() -> Column:
    """High and low enclose open and close; any null makes the row invalid."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return F.coalesce((h >= o) & (h >= c) & (l <= o) & (l <= c) & (h >= l), F.lit(False))


def negative_volume() -> Column:
    return F.coalesce(F.col("volume") < 0, F.lit(False))


def missing_any(columns: Sequence[str] = ("open", "high", "low", "close", "volume", "timestamp")) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def add_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"missing": missing_any(), "invalid_ohlc": ~valid_prices(), "invalid_volume": negative_volume()}
    )


def any_flag() -> Column:
    return F.col("missing") | F.col("invalid_ohlc") | F.col("invalid_volume")


def arrival(df: DataFrame, order: Sequence[str] = ("ingestion_time", "batch_seq")) -> Column:
    """Arrival order of a row: the order columns it has, then a hash of the row for equal ones."""
    present = [c for c in order if c in df.columns]
    return F.struct(*present, F.xxhash64(*df.columns).alias("_hash"))


def keep_last(df: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = ("ingestion_time", "batch_seq")) -> DataFrame:
    """One row per key, the latest to arrive, by a combinable max aggregate."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), arrival(df, order)).alias("_row")
    return df.groupBy(*keys).agg(last).select(*keys, "_row.*").select(*df.columns)


def duplicate_count(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows beyond the first of every key, per symbol."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("symbol").agg(F.sum(F.col("n") - 1).alias("duplicate_count"))


def silver(df: DataFrame) -> DataFrame:
    """Clean bars: invalid rows are dropped first, then the last arrival of each key is kept."""
    rows = add_flags(df)
    return keep_last(rows.filter(~any_flag()).drop(*REPORT))


def quarantine(df: DataFrame) -> DataFrame:
    """Rows rejected by Silver with `error_reason`; every row but the last of its key is a duplicate.

    Copies equal in every column cannot be told apart by arrival; they are counted and all but
    one of them is a duplicate.
    """
    rows = add_flags(df).withColumn("_ord", arrival(df))
    # Only keys with more than one row need a match; they are few in ordinary data.
    repeated = (
        rows.groupBy(*KEY)
        .agg(F.max("_ord").alias("_last"), F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > 1)
        .withColumnsRenamed({k: f"_{k}" for k in KEY})
    )
    same = F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("timestamp").eqNullSafe(F.col("_timestamp"))
    columns = [*df.columns, *REPORT, "duplicate"]
    single = rows.filter(any_flag()).join(repeated, same, "left_anti").withColumn("duplicate", F.lit(False))
    placed = rows.join(repeated, same)
    older = placed.filter(F.col("_ord") != F.col("_last")).withColumn("duplicate", F.lit(True))
    newest = placed.filter(F.col("_ord") == F.col("_last"))
    copies = newest.groupBy(*df.columns, *REPORT).agg(F.count(F.lit(1)).alias("_copies"))
    newest = copies.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    newest = newest.withColumn("duplicate", F.col("_i") < F.col("_copies"))
    flagged = single.select(*columns).unionByName(older.select(*columns)).unionByName(newest.select(*columns))
    flagged = flagged.filter(any_flag() | F.col("duplicate"))
    reason = F.concat(*[F.when(F.col(c), f"{c};").otherwise("") for c in (*REPORT, "duplicate")])
    return flagged.withColumn("error_reason", reason).drop(*REPORT, "duplicate")


def silver_quality(df: DataFrame) -> DataFrame:
    """Counts and status of a Silver run per symbol: two combinable aggregates, no row order."""
    rows = add_flags(df).withColumn("_ord", arrival(df)).withColumn("_bad", any_flag())
    count = lambda c: F.count_if(F.col(c))
    per_key = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        *[count(c).alias(c) for c in REPORT],
        F.bool_or(~F.col("_bad")).alias("kept"),
        F.max_by("_bad", "_ord").alias("last_bad"),
    )
    kept_at = F.when(F.col("kept"), F.col("timestamp"))
    out = per_key.groupBy("symbol").agg(
        F.sum("n").alias("source_count"),
        F.count_if("kept").alias("record_count"),
        F.sum(F.col("n") - 1).alias("duplicate_count"),
        *[F.sum(c).alias(f"{c}_count") for c in REPORT],
        (F.sum("n") - F.count_if(~F.col("last_bad"))).alias("error_count"),
        F.min(kept_at).alias("min_timestamp"),
        F.max(kept_at).alias("max_timestamp"),
    )
    status = (
        F.when(F.col("record_count") == 0, "failed").when(F.col("invalid_ohlc_count") == 0, "passed").otherwise("warning")
    )
    return out.withColumn("quality_status", status)


def validate(df: DataFrame) -> DataFrame:
    """Issue counts of bars per symbol, without changing them."""
    require(df, ["symbol", "timestamp", "open", "high", "low", "close", "volume"])
    rows = df.withColumns(
        {
            "missing": missing_any(("symbol", "timestamp", "open", "high", "low", "close", "volume")),
            "invalid_ohlc": ~valid_prices(),
            "invalid_volume": negative_volume(),
        }
    )
    per_key = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in REPORT]
    )
    return per_key.groupBy("symbol").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.col("n") - 1).alias("duplicate_count"),
        *[F.sum(c).alias(f"{c}_count") for c in REPORT],
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
    )


def quality_report(df: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Gate report per symbol; `expected` symbols without rows fail too."""
    report = validate(df)
    if expected is not None:
        report = expected.select(F.upper("symbol").alias("symbol")).distinct().join(report, "symbol", "left")
        counts = [c for c in report.columns if c.endswith("_count")]
        report = report.fillna(0, counts)
    critical = (F.col("invalid_ohlc_count") > 0) | (F.col("row_count") == 0)
    return report.withColumn("quality_status", F.when(critical, "failed").otherwise("passed"))


def passed_only(df: DataFrame, report: DataFrame) -> DataFrame:
    """Bars of the symbols that passed; one bad symbol does not stop the rest."""
    return df.join(report.filter(F.col("quality_status") == "passed").select("symbol"), "symbol", "left_semi")
