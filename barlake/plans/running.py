"""Exact running quantile of every series: at each row, over all rows up to it, with no look-ahead.

A window over the whole past of one symbol would be one task and one buffer per symbol. Here positions are cut into time
blocks and values into ranges, both of about BLOCK_ROWS rows:

1. All values are sorted by (series, value, position); runs of BLOCK_ROWS rows of that order are the ranges. Equal
   values may lie in several ranges, as the position breaks ties.
2. Rows are counted per (time block, range). Sums over earlier blocks and lower ranges tell how many earlier values lie
   below each range when a block begins.
3. While a block of m rows passes, the wanted rank moves by m places at most. The ranges that hold the ranks in reach,
   about three, are the only earlier values that the block needs.
4. Each block reads those values, inserts its own one by one and picks the ranks: an equi-join on (series, range) and one
   group of bounded size per (series, block).

Work and shuffle are linear in the rows: each value goes to the blocks whose ranks come near it. The grid of counts has
(rows / BLOCK_ROWS) squared cells per series, below the rows themselves up to a thousand million rows of one symbol.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.plans.materialize import stored
from barlake.plans.series import KEYS, POS, number_rows

BLOCK_ROWS = 32_768


def running_quantile(
    rows: DataFrame, value: str, p: float, keys: Sequence[str] = KEYS, order: str = "timestamp", out: str = "quantile",
    ties: Sequence[str] = (), bucket: str = "day", block_rows: int | None = None,
) -> DataFrame:
    """Keys, order column and the linearly interpolated p-quantile of the non-null values of `value` up to each row.

    Rows with a null value have none; read the one before for them (`last` non-null). NaN counts as null.
    """
    size, keys = block_rows or BLOCK_ROWS, list(keys)
    given = rows.select(*keys, order, *ties, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")).filter(F.col("_v").isNotNull())
    numbered = number_rows(given, keys, order, ties, bucket).select(*keys, order, F.col(POS).alias("_pos"), "_v")
    numbered = numbered.withColumn("_block", F.floor(F.col("_pos") / size))
    by_value = [*keys, "_v", "_pos"]

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            place = np.arange(seen, seen + batch.num_rows) // size + first
            seen += batch.num_rows
            yield batch.append_column("_range", pa.array(place, pa.int64()))

    sorted_ = numbered.repartitionByRange(*by_value).sortWithinPartitions(*by_value)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields) + ", _range bigint"
    # a range number comes from where a row lies in the sorted table, so it is fixed by writing it
    table = stored(sorted_.mapInArrow(ranged, schema), "running-quantile")

    counts = table.groupBy(*keys, "_block", "_range").agg(F.count(F.lit(1)).alias("_c"))
    blocks = counts.groupBy(*keys, "_block").agg(F.sum("_c").alias("_own"))
    ranges = counts.select(*keys, "_range").distinct()
    grid = blocks.join(ranges, keys).join(counts, [*keys, "_block", "_range"], "left").fillna(0, ["_c"])
    earlier = Window.partitionBy(*keys, "_range").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys, "_block").orderBy("_range")
    grid = grid.withColumn("_held", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    upto = F.sum("_held").over(lower.rowsBetween(Window.unboundedPreceding, 0))
    grid = grid.withColumns({"_upto": upto, "_before": F.sum("_held").over(Window.partitionBy(*keys, "_block"))})
    # ranks among the earlier values that a row of the block may ask for
    least = F.floor(F.lit(p) * F.col("_before")) - F.col("_own") - 2
    most = F.ceil(F.lit(p) * (F.col("_before") + F.col("_own"))) + 2
    near = grid.filter((F.col("_held") > 0) & (F.col("_upto") > least) & (F.col("_upto") - F.col("_held") <= most))
    near = near.select(*keys, F.col("_block").alias("_asks"), "_range", (F.col("_upto") - F.col("_held")).alias("_below"), "_before")

    old = table.select(*keys, "_range", "_block", "_v").join(near, [*keys, "_range"]).filter(F.col("_block") < F.col("_asks"))
    missing = {"_pos": "long", order: dict(table.dtypes)[order]}
    old = old.select(*keys, F.col("_asks").alias("_block"), "_v", *[F.lit(None).cast(t).alias(c) for c, t in missing.items()], "_below", "_before")
    before = blocks.withColumn("_before", F.coalesce(F.sum("_own").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = table.join(before.select(*keys, "_block", "_before"), [*keys, "_block"])
    own = own.select(*keys, "_block", "_v", *missing, F.lit(None).cast("long").alias("_below"), "_before")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        past, now = group[group["_pos"].isna()], group[group["_pos"].notna()].sort_values("_pos")
        values, below = sorted(past["_v"].tolist()), int(past["_below"].min()) if len(past) else 0
        lowest = values[0] if below else -math.inf
        n, found = int(now["_before"].iloc[0]), []
        whole = n == len(values)  # all earlier values are here
        highest = math.inf if whole or below + len(values) == n else values[-1]
        for v in now["_v"].tolist():
            n += 1
            if v < lowest:
                below += 1
            elif v <= highest:
                insort(values, v)
            rank = p * (n - 1)
            k = math.floor(rank)
            low = values[k - below]
            high = values[math.ceil(rank) - below]
            found.append(low + (high - low) * (rank - k))
        return now[[*keys, order]].assign(**{out: found})

    kinds = dict(table.dtypes)
    result = ", ".join([*(f"`{k}` {kinds[k]}" for k in [*keys, order]), f"`{out}` double"])
    return own.unionByName(old).groupBy(*keys, "_block").applyInPandas(pick, result)
