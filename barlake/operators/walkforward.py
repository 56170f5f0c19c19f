"""Walk-forward validation of all symbols.

Train slices all start at the first bar and only grow, and signals and equity never look ahead.
The equity at the end of a train slice is therefore the equity of one full run at that bar, so the
train phase is one backtest and a prefix over window steps, not one backtest per window. Test
slices have a fixed length; a bar falls into at most ceil(test / step) + 1 of them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators.backtest import backtest, metrics

DAY = 86_400


@dataclass(frozen=True)
class WalkForward:
    train_days: int = 180
    test_days: int = 30
    step_days: int = 20
    min_train_bars: int = 60
    min_test_bars: int = 20


def _spans(bars: DataFrame, plan: WalkForward) -> DataFrame:
    spans = bars.groupBy("symbol").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    length = F.unix_micros("end") - F.unix_micros("start") - plan.train_days * DAY * 1_000_000
    return spans.withColumn("n_windows", F.ceil(length / F.lit(plan.step_days * DAY * 1_000_000.0)))


def windows(bars: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    """Train and test ranges: the train end moves by one step until it passes the last bar."""
    w = _spans(bars, plan).filter(F.col("n_windows") > 0)
    w = w.withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_windows") - 1)))
    seconds = lambda s: F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    train_end = F.col("start") + seconds((F.col("window_id") * plan.step_days + plan.train_days) * DAY)
    w = w.withColumn("train_end", train_end)
    w = w.withColumn("test_start", F.col("train_end") + F.expr("interval 1 day"))
    test_end = F.least("end", F.col("test_start") + F.make_dt_interval(days=F.lit(plan.test_days)))
    return w.select(
        "symbol", "window_id", F.col("start").alias("train_start"), "train_end", "test_start", test_end.alias("test_end")
    )


def _train_step(plan: WalkForward) -> Column:
    """First window whose train slice holds the bar."""
    late = F.unix_micros("timestamp") - F.unix_micros("start") - plan.train_days * DAY * 1_000_000
    return F.greatest(F.lit(0).cast("long"), F.ceil(late / F.lit(plan.step_days * DAY * 1_000_000.0)))


def test_slices(bars: DataFrame, windows_: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    """Bars of each test slice: equi-join on (symbol, step bucket) and a range test.

    Buckets are as wide as a step, and a window covers test / step + 2 of them at most.
    """
    width = F.lit(plan.step_days * DAY)
    bucket = lambda c: F.floor(F.unix_seconds(c) / width)
    spread = windows_.select("symbol", "window_id", "test_start", "test_end").filter("test_start <= test_end")
    spread = spread.withColumn("_b", F.explode(F.sequence(bucket("test_start"), bucket("test_end"))))
    inside = F.col("timestamp").between(F.col("test_start"), F.col("test_end"))
    return (
        bars.withColumn("_b", bucket("timestamp"))
        .join(spread, ["symbol", "_b"])
        .filter(inside)
        .drop("_b", "test_start", "test_end")
    )


def _prefix(rows: DataFrame, bars: DataFrame, plan: WalkForward, *aggs: Column) -> DataFrame:
    return (
        rows.join(_spans(bars, plan).select("symbol", "start", "n_windows"), "symbol")
        .withColumn("window_id", _train_step(plan))
        .filter(F.col("window_id") < F.col("n_windows"))
        .groupBy("symbol", "window_id")
        .agg(*aggs)
    )


def slice_counts(bars: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    """Windows with the number of bars in their train and test slices."""
    w = windows(bars, plan)
    upto = Window.partitionBy("symbol").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    steps = _prefix(bars, bars, plan, F.count(F.lit(1)).alias("_n"))
    tests = test_slices(bars, w, plan).groupBy("symbol", "window_id").agg(F.count(F.lit(1)).alias("test_bars"))
    return (
        w.join(steps, ["symbol", "window_id"], "left")
        .join(tests, ["symbol", "window_id"], "left")
        .withColumn("train_bars", F.sum(F.coalesce("_n", F.lit(0))).over(upto))
        .withColumn("test_bars", F.coalesce("test_bars", F.lit(0)))
        .drop("_n")
    )


def walk_forward(
    bars: DataFrame,
    strategy: str,
    params: Mapping | None = None,
    plan: WalkForward = WalkForward(),
    initial_capital: float = 10_000.0,
    transaction_fee: float = 0.001,
    slippage: float = 0.0005,
    **cut,
) -> DataFrame:
    """One row per window: ranges, bars, train return, test metrics, pass flag and error text."""
    costs = dict(initial_capital=initial_capital, transaction_fee=transaction_fee, slippage=slippage)
    w = windows(bars, plan)
    upto = Window.partitionBy("symbol").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    full = backtest(bars, strategy, params, **costs, **cut)
    # A backtest has a row per bar, so the bars of both slices are counted in the aggregates that are needed anyway.
    count = F.count(F.lit(1))
    steps = _prefix(full, bars, plan, F.max_by("equity", "bar_no").alias("_equity"), count.alias("_n"))
    keys = ("symbol", "window_id")
    sliced = backtest(test_slices(bars, w, plan), strategy, params, keys=keys, **costs, **cut)
    tested = metrics(sliced, initial_capital, keys=keys, also={"test_bars": count}).select(
        *keys,
        "test_bars",
        F.col("total_return").alias("test_return"),
        F.col("sharpe_ratio").alias("test_sharpe"),
        F.col("maximum_drawdown").alias("test_max_drawdown"),
        F.col("win_rate").alias("test_win_rate"),
        F.col("number_of_trades").alias("test_num_trades"),
    )
    out = w.join(steps, [*keys], "left").join(tested, [*keys], "left")
    equity = F.last("_equity", True).over(upto)
    train_bars = F.sum(F.coalesce("_n", F.lit(0))).over(upto)
    out = out.withColumns({"_equity": equity, "train_bars": train_bars, "test_bars": F.coalesce("test_bars", F.lit(0))})
    passed = (F.col("train_bars") >= plan.min_train_bars) & (F.col("test_bars") >= plan.min_test_bars)
    out = out.withColumns({"train_return": F.col("_equity") / float(initial_capital) - 1, "passed": passed}).drop("_equity", "_n")
    measured = ["train_return", *[c for c in out.columns if c.startswith("test_") and c not in ("test_start", "test_end", "test_bars")]]
    out = out.withColumns({c: F.when(F.col("passed"), F.col(c)) for c in measured})
    return out.withColumn("error", F.when(~F.col("passed"), "Insufficient bars in window"))


def summary(windows_: DataFrame) -> DataFrame:
    """Per symbol: windows passed and failed, mean and population deviation of returns, stability."""
    avg_train, avg_test = F.avg("train_return"), F.avg("test_return")
    return windows_.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.count_if("passed").alias("passed_windows"),
        F.count_if(~F.col("passed")).alias("failed_windows"),
        avg_train.alias("avg_train_return"),
        F.stddev_pop("train_return").alias("train_return_std"),
        avg_test.alias("avg_test_return"),
        F.stddev_pop("test_return").alias("test_return_std"),
        F.avg("test_sharpe").alias("avg_test_sharpe"),
        F.avg("test_max_drawdown").alias("avg_test_max_drawdown"),
        F.avg("test_win_rate").alias("avg_test_win_rate"),
        F.coalesce(F.sum("test_num_trades"), F.lit(0)).alias("total_test_trades"),
        F.coalesce(F.try_divide(F.count_if(F.col("test_return") > 0), F.count("test_return")), F.lit(0.0)).alias(
            "return_consistency"
        ),
        F.try_divide(avg_train, avg_test).alias("overfitting_ratio"),
    )
