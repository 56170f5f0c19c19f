"""Operators on streams of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators.market import alerts
from barlake.operators.resample import bar_aggregates


def once(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated (symbol, timestamp) within the watermark; a later copy of a bar is lost here, so raw
    bars that may be corrected go to the upsert instead."""
    return bars.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["symbol", "timestamp"])


def tumble(bars: DataFrame, width: str, delay: str = "1 hour", repeats: bool = False) -> DataFrame:
    """Bars of one width from a stream; a bucket is emitted once the watermark has passed it.

    With `repeats` the stream may deliver a bar more than once and copies are dropped first.

    Partial aggregates are combined per task before the shuffle, so a busy symbol sends one row per
    bucket and task.
    """
    timed = once(bars, delay) if repeats else bars.withWatermark("timestamp", delay)
    return (
        timed.groupBy("symbol", F.window("timestamp", width).alias("w"))
        .agg(*bar_aggregates(F.col("timestamp")))
        .select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")
    )


def stream_alerts(bars: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of a stream against a static rule table."""
    return alerts(bars, rules)


def enrich(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Streamed bars with the latest stored feature row of their symbol (stream-static join)."""
    own = set(bars.columns)
    kept = [c for c in features.columns if c not in own]
    newest = features.groupBy("symbol").agg(F.max_by(F.struct(*kept), "timestamp").alias("f"))
    return bars.join(newest, "symbol", "left").select(*bars.columns, "f.*")
