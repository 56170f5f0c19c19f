"""Filters, layer choice, newest rows and small selections over bars, news and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.plans.series import KEYS, tail_n


def of_symbol(df: DataFrame, symbol: str, column: str = "symbol") -> DataFrame:
    return df.filter(F.col(column) == symbol.upper())


def in_range(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "timestamp") -> DataFrame:
    """Inclusive time range; reaches the scan as a pushed filter."""
    if start:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col(column) <= F.lit(end).cast("timestamp"))
    return df


def lookback(df: DataFrame, as_of: str | Column, column: str = "timestamp", days: int = 0, years: int = 0) -> DataFrame:
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return df.filter(F.col(column) >= now - F.make_interval(years=F.lit(years), days=F.lit(days)))


def new_rows(df: DataFrame, seen: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows newer than the last seen time of their symbol; unseen symbols pass whole."""
    high = seen.groupBy(*keys).agg(F.max("timestamp").alias("_seen"))
    joined = df.join(high, list(keys), "left")
    return joined.filter(F.col("_seen").isNull() | (F.col("timestamp") > F.col("_seen"))).drop("_seen")


def valid_symbol(column: str = "symbol") -> Column:
    return F.col(column).rlike("^[A-Za-z]{1,5}$")


def first_source(frames: Sequence[tuple[str, DataFrame]], tag: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key, the rows of the first frame in the list that has any."""
    tagged = [df.withColumns({tag: F.lit(name), "_priority": F.lit(i)}) for i, (name, df) in enumerate(frames)]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    best = every.groupBy(*keys).agg(F.min("_priority").alias("_priority"))
    return every.join(best, [*keys, "_priority"], "left_semi").drop("_priority")


def history(gold: DataFrame, silver: DataFrame, bronze: DataFrame, interval: str = "1d") -> DataFrame:
    """Bars from the best layer each symbol has."""
    rows = first_source([("gold", gold), ("silver", silver), ("bronze", bronze)], "layer")
    return rows.withColumn("interval", F.lit(interval))


def latest(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "timestamp") -> DataFrame:
    """The newest row of every key."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def latest_change(bars: DataFrame) -> DataFrame:
    """Newest bar with its change against the previous close (0 without one or on a zero base)."""
    two = tail_n(bars, 2)
    w = Window.partitionBy("symbol").orderBy("timestamp")
    # At most two rows per symbol are left here.
    before = F.coalesce(F.lag("close").over(w), F.col("close"))
    change = F.coalesce(F.try_divide(F.col("close") - before, before), F.lit(0.0))
    last = two.withColumns({"prev_close": before, "change_pct": change, "_rn": F.row_number().over(w.orderBy(F.desc("timestamp")))})
    return last.filter(F.col("_rn") == 1).drop("_rn")


def recent(df: DataFrame, as_of: str | Column, days: int, rows: int) -> DataFrame:
    """Newest rows after a lookback."""
    return tail_n(lookback(df, as_of, days=days), rows)


def newest_runs(runs: DataFrame, limit: int, symbol: str | None = None, order: str = "created_at") -> DataFrame:
    runs = runs if symbol is None else of_symbol(runs, symbol)
    return runs.orderBy(F.desc(order)).limit(limit)


def latest_per_model(runs: DataFrame) -> DataFrame:
    """Latest run of each (symbol, model)."""
    return latest(runs, ("symbol", "model_name"), "created_at")


def top_k(df: DataFrame, k: int | None, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First k rows per key (None: all, ranked); Spark prunes to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)
