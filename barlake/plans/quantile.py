"""Exact per-key quantile by counting digits: nothing is sampled, and no key is ordered as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coarse digits per factor of e, and fine digits per coarse one.
COARSE, FINE = 512, 4096
#: Above any logarithm of a double times COARSE.
MIDDLE = 1_000_000


def _coarse(v: Column) -> Column:
    """A whole number that never falls as the value rises: steps of the logarithm on both sides of zero."""
    steps = lambda x: F.floor(F.least(F.ln(x), F.lit(800.0)) * COARSE) + MIDDLE
    return F.when(v > 0, steps(v)).when(v < 0, -steps(-v)).otherwise(F.lit(0).cast("long"))


def _fine(v: Column) -> Column:
    """Place of a value between the least and the greatest of its coarse digit."""
    low, high = F.col("_least"), F.col("_most")
    return F.when(high > low, F.floor((v - low) / (high - low) * FINE)).otherwise(F.lit(0).cast("long"))


def _holding(counts: DataFrame, group: Sequence[str], by: str, p: float) -> DataFrame:
    """The counted entries that hold a wanted rank, with the number of the key's values up to their end (`_upto`)."""
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.lit(p) * (F.col("_total") - 1)
    counts = counts.withColumn("_upto", F.col("_base") + upto)
    return counts.filter((F.col("_upto") - F.col("_c") <= F.ceil(rank)) & (F.col("_upto") > F.floor(rank)))


def exact_quantile(df: DataFrame, value: str, p: float, keys: Sequence[str] = ("symbol",), out: str = "quantile") -> DataFrame:
    """One row per key: linearly interpolated p-quantile of the values; null and NaN count as missing.

    Three counts, all of them mergeable: values per coarse digit; values per fine digit in the one or two coarse digits
    that hold the wanted ranks; distinct values in the one or two fine digits that hold them. A digit only has to rise
    with the value for the result to be exact, whatever the values are; equal values are one entry of the last count.
    """
    keys = list(keys)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    data = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_d", _coarse(F.col("_v")))
    n = F.count(F.lit(1)).alias("_c")
    first = F.col("_upto") - F.col("_c")

    coarse = data.groupBy(*keys, "_d").agg(n, F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    coarse = coarse.withColumns({"_total": F.sum("_c").over(Window.partitionBy(*keys)), "_base": F.lit(0).cast("long")})
    held = _holding(coarse, keys, "_d", p).select(*keys, "_d", "_least", "_most", "_total", first.alias("_base"))
    inside = data.join(held, [*keys, "_d"]).withColumn("_f", _fine(F.col("_v")))

    fine = inside.groupBy(*keys, "_d", "_f", "_total", "_base").agg(n)
    held = _holding(fine, [*keys, "_d"], "_f", p).select(*keys, "_d", "_f", "_total", first.alias("_base"))
    inside = inside.select(*keys, "_d", "_f", "_v").join(held, [*keys, "_d", "_f"])

    values = inside.groupBy(*keys, "_d", "_f", "_total", "_base", "_v").agg(n)
    rank = F.lit(p) * (F.col("_total") - 1)
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    found = _holding(values, [*keys, "_d", "_f"], "_v", p).groupBy(*keys, "_total").agg(
        at(F.floor(rank)).alias("_low"), at(F.ceil(rank)).alias("_high")
    )
    share = rank - F.floor(rank)
    between = F.col("_low") + F.when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) * share).otherwise(0.0)
    return found.select(*keys, between.alias(out))
