"""Ordered-series primitives that never put one whole symbol into one task.

A plain ``Window.partitionBy("symbol")`` gives every row of a symbol to one task. Here a
series is cut into blocks instead:

* ``number_rows`` gives each row its position in its series. Rows are sorted inside
  (key, calendar day) only; the start of each day comes from a table of per-day row counts,
  which has at most one row per calendar day and key.
* ``blocks`` cuts the positions into equal blocks and copies the rows next to a border into
  the neighbouring block (the halo), so bounded frames see all their rows.
* ``ema`` evaluates recursive averages inside a block from decayed partial sums.
* ``scan`` extends a running aggregate over block borders with one summary row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS, TOTAL, BLOCK, SUB, CORE, DAY = "_pos", "_n", "_block", "_sub", "_core", "_day"
HELPERS = [POS, TOTAL, BLOCK, SUB, CORE, DAY]
BLOCK_ROWS = 32_768
SUB_ROWS = 512
KEYS = ("symbol",)


def day_counts(
    df: DataFrame, keys: Sequence[str] = KEYS, order: str = "timestamp", bucket: str = "day"
) -> DataFrame:
    """One row per (key, day): rows in it, rows before it, rows in the whole series.

    `bucket` names a finer or coarser calendar unit for series with very many or few rows a day.
    """
    per_day = df.groupBy(*keys, F.date_trunc(bucket, order).alias(DAY)).agg(F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    return per_day.select(
        *keys,
        DAY,
        "_rows",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(by_key).alias(TOTAL),
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = "timestamp",
    ties: Sequence[str] = (),
    bucket: str = "day",
) -> DataFrame:
    """Add the 0-based position `_pos` and the series length `_n`."""
    counts = day_counts(df, keys, order, bucket).drop("_rows")
    in_day = Window.partitionBy(*keys, DAY).orderBy(order, *ties)
    rows = df.withColumn(DAY, F.date_trunc(bucket, order)).withColumn("_rn", F.row_number().over(in_day))
    return (
        rows.join(counts, [*keys, DAY])
        .withColumn(POS, F.col("_before") + F.col("_rn") - 1)
        .drop("_before", "_rn", DAY)
    )


@dataclass(frozen=True)
class Blocks:
    """A frame cut into (key, `_block`) groups of bounded size, in `_pos` order."""

    df: DataFrame
    keys: tuple[str, ...] = KEYS
    order: tuple[str, ...] = (SUB, POS)

    @property
    def w(self) -> Window:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order)

    @property
    def sub(self) -> Window:
        frame = Window.partitionBy(*self.keys, BLOCK, SUB).orderBy(POS)
        return frame.rowsBetween(Window.unboundedPreceding, 0)

    def trailing(self, n: int) -> Window:
        return self.w.rowsBetween(-(n - 1), 0)

    def running(self, until: int = 0) -> Window:
        return self.w.rowsBetween(Window.unboundedPreceding, until)

    def add(self, columns: dict[str, Column]) -> "Blocks":
        return replace(self, df=self.df.withColumns(columns))

    def lag(self, column: str | Column, n: int = 1) -> Column:
        return F.lag(column, n).over(self.w)

    def lead(self, column: str | Column, n: int = 1) -> Column:
        return F.lead(column, n).over(self.w)

    def rolling(self, fn, column: str | Column, n: int, min_periods: int | None = None) -> Column:
        """`fn` over the last n rows; null until `min_periods` (default n) non-null values."""
        if n <= 0:
            raise ValueError("window must be positive")
        column = F.col(column) if isinstance(column, str) else column
        if min_periods is None:
            # The newest null tells whether the frame is full and has no null, at the cost of one running value.
            newest_null = F.last(F.when(column.isNull(), F.col(POS)), True).over(self.running())
            full = F.col(POS) - F.coalesce(newest_null, F.lit(-1)) >= n
        else:
            full = F.count(column).over(self.trailing(n)) >= min_periods
        return F.when(full, fn(column).over(self.trailing(n)))

    def add_rolling(self, specs: dict[str, tuple], others: dict[str, Column] | None = None) -> "Blocks":
        """Several `rolling` columns {name: (fn, column, n)} and other window columns in one window step.

        The running position of the newest null is computed once per input column.
        """
        for _, _, n in specs.values():
            if n <= 0:
                raise ValueError("window must be positive")
        nulls = {
            f"_null_{c}": F.last(F.when(F.col(c).isNull(), F.col(POS)), True).over(self.running())
            for c in dict.fromkeys(c for _, c, _ in specs.values())
        }
        raw = {f"_raw_{name}": fn(F.col(c)).over(self.trailing(n)) for name, (fn, c, n) in specs.items()}
        b = self.add({**nulls, **raw, **(others or {})})
        full = lambda c, n: F.col(POS) - F.coalesce(F.col(f"_null_{c}"), F.lit(-1)) >= n
        b = b.add({name: F.when(full(c, n), F.col(f"_raw_{name}")) for name, (_, c, n) in specs.items()})
        return replace(b, df=b.df.drop(*nulls, *raw))

    def core(self) -> "Blocks":
        """Drop the halo copies; every row is present exactly once afterwards."""
        return replace(self, df=self.df.filter(CORE))

    def rows(self) -> DataFrame:
        return self.core().df.drop(*HELPERS)


def blocks(
    df: DataFrame,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    block_rows: int | None = None,
) -> Blocks:
    """Cut a numbered frame into blocks, each with `before`/`after` halo rows."""
    size = block_rows or BLOCK_ROWS
    own = F.floor(F.col(POS) / size)
    if before or after:
        first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(POS) - after) / size))
        last = F.least(F.floor((F.col(TOTAL) - 1) / size), F.floor((F.col(POS) + before) / size))
        out = df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(CORE, F.col(BLOCK) == own)
    else:
        out = df.withColumn(BLOCK, own).withColumn(CORE, F.lit(True))
    return Blocks(out.withColumn(SUB, F.floor(F.col(POS) / SUB_ROWS)), tuple(keys))


def series(
    df: DataFrame,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    order: str = "timestamp",
    ties: Sequence[str] = (),
    block_rows: int | None = None,
    bucket: str = "day",
) -> Blocks:
    """`number_rows` followed by `blocks`."""
    return blocks(number_rows(df, keys, order, ties, bucket), before, after, keys, block_rows)


# --- recursive averages --------------------------------------------------------------------


NEGLIGIBLE = 5e-17  # below half a unit in the last place of a double


def _levels(q: float) -> int:
    """Whole sub-blocks to look back until the weight of older values is negligible."""
    return max(1, ceil(log(NEGLIGIBLE) / (SUB_ROWS * log(q)))) if q > 0 else 1


def ema_halo(*alphas: float) -> int:
    """Rows needed in front of a block so that its averages do not depend on the cut."""
    return max((_levels(1 - a) + 1) * SUB_ROWS for a in alphas)


def ema(b: Blocks, specs: dict[str, tuple[str, float, int, int]]) -> Blocks:
    """Recursive averages y = (1-a) y' + a x, seeded with the first value.

    `specs` maps an output column to (input column, a, position of the first value,
    min_periods). The input must have no nulls after its first value. With a = 1 the average is
    the input itself.
    """
    whole = {name: spec for name, spec in specs.items() if spec[1] >= 1}
    if whole:
        b = b.add({name: F.when(F.col(POS) >= start + least - 1, F.col(source)) for name, (source, _, start, least) in whole.items()})
        specs = {name: spec for name, spec in specs.items() if spec[1] < 1}
        if not specs:
            return b
    pos, j = F.col(POS), F.col(POS) % SUB_ROWS
    local, tails, out = {}, {}, {}
    for name, (source, alpha, start, _) in specs.items():
        q = 1 - alpha
        checked = F.when(pos > start, F.coalesce(F.col(source), F.raise_error(F.lit(f"null inside the series of {name}")).cast("double")))
        term = F.when(pos == start, F.col(source)).when(pos > start, checked * alpha)
        decayed = F.sum(term * F.pow(F.lit(q), -j)).over(b.sub)
        local[f"_l_{name}"] = F.coalesce(decayed * F.pow(F.lit(q), j), F.lit(0.0))
    b = b.add(local)
    for name, (_, alpha, _, _) in specs.items():
        q, total = 1 - alpha, F.col(f"_l_{name}")
        for level in range(1, _levels(q)):
            step = level * SUB_ROWS
            total = total + F.lit(q**step) * F.coalesce(b.lag(f"_l_{name}", step), F.lit(0.0))
        tails[f"_t_{name}"] = F.when(j == SUB_ROWS - 1, total)
    b = b.add(tails)
    for name, (_, alpha, start, min_periods) in specs.items():
        carry = F.coalesce(F.last(f"_t_{name}", True).over(b.running(-1)), F.lit(0.0))
        value = F.col(f"_l_{name}") + F.pow(F.lit(1 - alpha), j + 1) * carry
        out[name] = F.when(pos >= start + min_periods - 1, value)
    b = b.add(out)
    return replace(b, df=b.df.drop(*local, *tails))


# --- running aggregates over block borders ---------------------------------------------------

_RUNNING = {
    "sum": (F.sum, lambda a, c: F.coalesce(a, F.lit(0)) + F.coalesce(c, F.lit(0))),
    "product": (F.product, lambda a, c: F.coalesce(a, F.lit(1.0)) * F.coalesce(c, F.lit(1.0))),
    "max": (F.max, lambda a, c: F.greatest(a, c)),
    "min": (F.min, lambda a, c: F.least(a, c)),
    "last": (lambda x: F.last(x, True), lambda a, c: F.coalesce(a, c)),
}


def scan(b: Blocks, specs: dict[str, tuple[str, Column]], exclusive: dict[str, str] | None = None) -> Blocks:
    """Running aggregates from the start of each series up to the current row.

    `specs` maps an output to (kind, expression); `exclusive` maps an extra output to the
    spec it repeats without the current row. Only one summary row per block crosses tasks.
    """
    exclusive = exclusive or {}
    inputs = {f"_x_{name}": expr for name, (_, expr) in specs.items()}
    b = b.add(inputs)
    totals = []
    for name, (kind, _) in specs.items():
        x = F.col(f"_x_{name}")
        if kind == "last":
            total = F.max_by(x, F.when(x.isNotNull(), F.col(POS)))
        else:
            total = _RUNNING[kind][0](x)
        totals.append(total.alias(f"_s_{name}"))
    summary = b.df.groupBy(*b.keys, BLOCK).agg(*totals)
    earlier = Window.partitionBy(*b.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carries = summary.select(
        *b.keys,
        BLOCK,
        *[_RUNNING[kind][0](F.col(f"_s_{name}")).over(earlier).alias(f"_c_{name}") for name, (kind, _) in specs.items()],
    )
    local = {f"_i_{n}": _RUNNING[k][0](F.col(f"_x_{n}")).over(b.running()) for n, (k, _) in specs.items()}
    for out, name in exclusive.items():
        local[f"_i_{out}"] = _RUNNING[specs[name][0]][0](F.col(f"_x_{name}")).over(b.running(-1))
    df = b.add(local).df.join(carries, [*b.keys, BLOCK])
    merged = {}
    for out, name in [*((n, n) for n in specs), *exclusive.items()]:
        merge = _RUNNING[specs[name][0]][1]
        merged[out] = merge(F.col(f"_i_{out}"), F.col(f"_c_{name}"))
    df = df.withColumns(merged).drop(*inputs, *local, *[f"_c_{n}" for n in specs])
    return replace(b, df=df)


# --- last rows -------------------------------------------------------------------------------


def tail_n(
    df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = "timestamp", bucket: str = "day"
) -> DataFrame:
    """The last n rows of every series.

    Per-day counts tell which days can hold them, so only those days are shuffled.
    """
    days = (
        day_counts(df, keys, order, bucket)
        .filter(F.col("_before") + F.col("_rows") > F.col(TOTAL) - n)
        .select(*keys, DAY)
    )
    recent = df.withColumn(DAY, F.date_trunc(bucket, order)).join(days, [*keys, DAY], "left_semi")
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return recent.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn", DAY)


def as_of(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    on: str = "timestamp",
    right_on: str = "timestamp",
) -> DataFrame:
    """Backward as-of join: each column's newest non-null value of the right rows not after the left row.

    `right` is one series (one row per time); values are carried over its nulls by a block scan first. Each right row is valid until the next one; the
    validity is cut into calendar days, which makes the match an equi-join on the day plus a range
    test, with no ordered pass over the left side. The right side grows to one row per day at least.
    """
    horizon = left.agg(F.max(on)).scalar()
    side = right.select(F.lit(0).alias("_series"), F.col(right_on).alias("_from"), *values)
    carried = scan(series(side, keys=["_series"], order="_from"), {f"_f_{v}": ("last", F.col(v)) for v in values}).rows()
    side = carried.select("_series", "_from", *[F.col(f"_f_{v}").alias(v) for v in values])
    b = series(side, after=1, keys=["_series"], order="_from")
    side = b.add({"_to": b.lead("_from")}).core().df.select("_from", "_to", *values)
    last = F.greatest(F.to_date("_from"), F.to_date(F.coalesce(F.col("_to"), horizon)))
    side = side.withColumn("_day_r", F.explode(F.sequence(F.to_date("_from"), last)))
    fits = (
        (F.col("_day_l") == F.col("_day_r"))
        & (F.col(on) >= F.col("_from"))
        & (F.col("_to").isNull() | (F.col(on) < F.col("_to")))
    )
    return left.withColumn("_day_l", F.to_date(on)).join(side, fits, "left").drop("_day_l", "_day_r", "_from", "_to")
