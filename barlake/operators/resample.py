"""Bars at coarser intervals, from ticks or from finer bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.schemas import INTERVALS


def ticks_to_bars(ticks: DataFrame) -> DataFrame:
    """A tick as a bar of its own; `seq` orders ticks of the same time."""
    return ticks.select(
        "symbol",
        "timestamp",
        F.col("tick_id").alias("seq"),
        *[F.col("price").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(1.0).alias("volume"),
    )


def bar_aggregates(order) -> list:
    return [
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def resample_one(bars: DataFrame, width: str) -> DataFrame:
    """Bars of one width, left-closed and labelled by their start; the first bar opens, the last closes."""
    order = F.struct("timestamp", "seq") if "seq" in bars.columns else F.col("timestamp")
    bucket = F.window("timestamp", width).start.alias("bucket")
    return bars.groupBy("symbol", bucket).agg(*bar_aggregates(order)).withColumnRenamed("bucket", "timestamp")


def resample(bars: DataFrame, intervals: dict[str, str] = INTERVALS) -> DataFrame:
    """Bars of every interval.

    The input is read and shuffled once, into the finest interval; the coarser ones are
    aggregated from that much smaller result.
    """
    names = list(intervals)
    finest = resample_one(bars, intervals[names[0]])
    # F.window may appear once per projection, so epoch arithmetic gives the bucket starts here.
    seconds = {n: F.lit(_seconds(intervals[n])) for n in names}
    starts = [
        F.struct(
            F.lit(n).alias("interval"),
            F.timestamp_seconds(F.unix_seconds("timestamp") - F.pmod(F.unix_seconds("timestamp"), s)).alias("start"),
        )
        for n, s in seconds.items()
    ]
    each = finest.withColumn("b", F.explode(F.array(*starts))).select("*", "b.*").drop("b")
    return (
        each.groupBy("symbol", "interval", "start")
        .agg(*bar_aggregates(F.col("timestamp")))
        .withColumnRenamed("start", "timestamp")
    )


def _seconds(width: str) -> int:
    number, unit = width.split()
    return int(number) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
