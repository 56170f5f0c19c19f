"""Long-only backtests of all symbols as running aggregates, with no row loop.

All-in, all-out trading has one bit of state: the sign of the last order. Entries and exits are
its changes, and capital is the running product of fill ratios. Each block of bars is evaluated once
for both states it may start in; one summary row per block then tells which case holds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.operators.indicators import add_rsi, halo
from barlake.plans.series import BLOCK, KEYS, POS, TOTAL, Blocks, scan, series


@dataclass(frozen=True)
class Strategy:
    """A rule that adds `_raw` (1 buy, -1 sell, 0 none) from at most `lookback` earlier bars.

    `crossings` drops a signal that repeats the last non-zero one.
    """

    raw: Callable[[Blocks, Mapping], Blocks]
    lookback: Callable[[Mapping], int]
    crossings: bool = False


def _crossover(b: Blocks, p: Mapping) -> Blocks:
    short = b.rolling(F.avg, "close", int(p.get("short_window", 20)))
    long = b.rolling(F.avg, "close", int(p.get("long_window", 50)))
    b = b.add({"_side": F.when(F.coalesce(short > long, F.lit(False)), 1).otherwise(0)})
    return b.add({"_raw": F.coalesce(F.col("_side") - b.lag("_side"), F.lit(0)).cast("double")})


def _rsi_threshold(b: Blocks, p: Mapping) -> Blocks:
    b = add_rsi(b, int(p.get("rsi_period", 14)), out="_rsi")
    low, high = float(p.get("lower_threshold", 30)), float(p.get("upper_threshold", 70))
    return b.add({"_raw": F.when(F.col("_rsi") < low, 1.0).when(F.col("_rsi") > high, -1.0).otherwise(0.0)})


STRATEGIES: dict[str, Strategy] = {
    "ma_crossover": Strategy(
        _crossover, lambda p: max(int(p.get("short_window", 20)), int(p.get("long_window", 50))) + 1
    ),
    "rsi_strategy": Strategy(
        _rsi_threshold, lambda p: halo({"rsi": (int(p.get("rsi_period", 14)),)}, ["rsi"]), True
    ),
}


def strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy: {name}")
    return STRATEGIES[name]


def _nonzero(column: str) -> Column:
    return F.when(F.col(column) != 0, F.signum(column))


def signals(bars: DataFrame, name: str, params: Mapping | None = None, keys: Sequence[str] = KEYS, **cut) -> DataFrame:
    """Bars with `signal` at the close of each bar."""
    rule, params = strategy(name), params or {}
    b = rule.raw(series(bars, before=rule.lookback(params), keys=keys, **cut), params).core()
    if rule.crossings:
        b = scan(b, {"_upto": ("last", _nonzero("_raw"))}, {"_prior": "_upto"})
        repeated = F.coalesce(F.col("_raw") == F.col("_prior"), F.lit(False))
        b = b.add({"signal": F.when(repeated, 0.0).otherwise(F.col("_raw"))})
    else:
        b = b.add({"signal": F.col("_raw")})
    return b.df.select(*bars.columns, "signal")


def execution(bars: DataFrame, name: str, params: Mapping | None = None, keys: Sequence[str] = KEYS, **cut) -> DataFrame:
    """Bars with `exec_signal`: the signal of the previous bar, 0 on the first."""
    rule, params = strategy(name), params or {}
    b = rule.raw(series(bars, before=rule.lookback(params) + 1, keys=keys, **cut), params)
    b = b.add({"_raw": F.coalesce(b.lag("_raw"), F.lit(0.0))}).core()
    if rule.crossings:
        b = scan(b, {"_upto": ("last", _nonzero("_raw"))}, {"_prior": "_upto"})
        repeated = F.coalesce(F.col("_raw") == F.col("_prior"), F.lit(False))
        b = b.add({"_raw": F.when(repeated, 0.0).otherwise(F.col("_raw"))})
    return b.df.select(*bars.columns, F.col("_raw").alias("exec_signal"))


def _with_both_states(b: Blocks, fee: float, slippage: float) -> Blocks:
    """Running trade state inside each block, for a flat (suffix 0) and a long (suffix 1) start.

    Only the first order of a block depends on the state it starts in, so both cases cost one pass.
    """
    price = F.coalesce("open", "close")
    b = b.add(
        {
            "_price": price,
            "_in": price * (1 + slippage),
            "_out": price * (1 - slippage),
            "_last": F.last("_order", True).over(b.running()),
            "_prior": F.last("_order", True).over(b.running(-1)),
        }
    )
    cases = {"0": False, "1": True}
    row: dict[str, Column] = {}
    for case, start in cases.items():
        long, was = (F.coalesce(F.col(c) > 0, F.lit(start)) for c in ("_last", "_prior"))
        row |= {f"_long{case}": long, f"_was{case}": was, f"_enter{case}": long & ~was, f"_leave{case}": was & ~long}
    b = b.add(row)
    row, running = {}, {}
    for case in cases:
        enter, leave = F.col(f"_enter{case}"), F.col(f"_leave{case}")
        row[f"_factor{case}"] = (
            F.when(enter, 1.0 / ((1 + fee) * F.col("_in"))).when(leave, F.col("_out") * (1 - fee)).otherwise(1.0)
        )
        row[f"_open{case}"] = F.when(enter, F.struct(F.col("timestamp").alias("at"), F.col("_in").alias("price")))
        running |= {
            f"_growth{case}": F.product(f"_factor{case}").over(b.running()),
            f"_grown{case}": F.coalesce(F.product(f"_factor{case}").over(b.running(-1)), F.lit(1.0)),
            f"_count{case}": F.count_if(enter).over(b.running()),
            f"_opened{case}": F.last(f"_open{case}", True).over(b.running()),
        }
    b = b.add(row).add(running)
    worth = lambda case: F.col(f"_growth{case}") * F.when(F.col(f"_long{case}"), F.col("close")).otherwise(F.lit(1.0))
    b = b.add({f"_worth{case}": worth(case) for case in cases})
    return b.add({f"_peak{case}": F.max(f"_worth{case}").over(b.running()) for case in cases})


def _carries(b: Blocks) -> DataFrame:
    """State, growth, trades, open entry and peak that every block starts with: one short row per block."""
    kept = ["_last", *[f"{c}{case}" for case in "01" for c in ("_growth", "_count", "_opened", "_peak")]]
    ends = b.df.groupBy(*b.keys, BLOCK).agg(F.max_by(F.struct(*kept), POS).alias("e")).select(*b.keys, BLOCK, "e.*")
    earlier = Window.partitionBy(*b.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last("_last", True).over(earlier) > 0, F.lit(False))
    ends = ends.withColumn("_held", held)
    pick = lambda c: F.when(F.col("_held"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    ends = ends.withColumns({c: pick(c) for c in ("_growth", "_count", "_opened", "_peak")})
    ends = ends.withColumns(
        {
            "_growth_in": F.coalesce(F.product("_growth").over(earlier), F.lit(1.0)),
            "_count_in": F.coalesce(F.sum("_count").over(earlier), F.lit(0)),
            "_opened_in": F.last("_opened", True).over(earlier),
        }
    )
    peak = F.max(F.col("_growth_in") * F.col("_peak")).over(earlier)
    return ends.withColumn("_peak_in", peak).select(
        *b.keys, BLOCK, "_held", "_growth_in", "_count_in", "_opened_in", "_peak_in"
    )


def backtest(
    bars: DataFrame,
    name: str,
    params: Mapping | None = None,
    initial_capital: float = 10_000.0,
    transaction_fee: float = 0.001,
    slippage: float = 0.0005,
    keys: Sequence[str] = KEYS,
    **cut,
) -> DataFrame:
    """One row per bar: equity, drawdown, return, position, marker and the trade closed on it.

    The order of bar t is filled at the open of bar t+1 (its close when there is no open). A position
    left at the last bar is sold at that close; this trade is not part of the equity curve.
    """
    if initial_capital <= 0:
        raise ValueError("initial_capital must be positive")
    rule, params = strategy(name), params or {}
    bars = bars.select(*keys, "timestamp", "open", "close")
    b = rule.raw(series(bars, before=rule.lookback(params) + 1, keys=keys, **cut), params)
    b = b.add({"_order": b.lag(_nonzero("_raw")), "_prev_close": b.lag("close")}).core()
    # Repeated orders do not change the state, so crossings need no separate pass here.
    b = _with_both_states(b, transaction_fee, slippage)
    rows = b.df.join(_carries(b), [*keys, BLOCK])
    pick = lambda c: F.when(F.col("_held"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    rows = rows.withColumns({c: pick(c) for c in ("_long", "_was", "_enter", "_leave", "_growth", "_grown", "_count", "_opened", "_peak")})
    rows = rows.withColumns(
        {
            "long": F.col("_long"),
            "trade_id": F.col("_count") + F.col("_count_in"),
            "_opened": F.coalesce("_opened", "_opened_in"),
            "_growth": F.col("_growth") * F.col("_growth_in"),
            "_growth_before": F.col("_grown") * F.col("_growth_in"),
            "_peak": F.greatest(F.col("_peak") * F.col("_growth_in"), F.col("_peak_in")),
        }
    )
    capital = F.lit(float(initial_capital))
    worth = lambda growth, held, close: capital * growth * F.when(held, close).otherwise(F.lit(1.0))
    rows = rows.withColumns(
        {
            "equity": worth(F.col("_growth"), F.col("long"), F.col("close")),
            "_equity_before": worth(F.col("_growth_before"), F.col("_was"), F.col("_prev_close")),
            "_peak": capital * F.col("_peak"),
        }
    )
    last_open = (F.col(POS) == F.col(TOTAL) - 1) & F.col("long")
    exit_price = F.when(last_open, F.col("close") * (1 - slippage)).otherwise(F.col("_out"))
    quantity = capital * F.when(last_open, F.col("_growth")).otherwise(F.col("_growth_before"))
    spent = F.col("quantity") * F.col("_opened.price")
    net = F.col("quantity") * F.col("exit_price") * (1 - transaction_fee)
    rows = rows.withColumns({"quantity": quantity, "exit_price": exit_price})
    trade = F.struct(
        "trade_id",
        F.col("_opened.at").alias("entry_time"),
        F.col("timestamp").alias("exit_time"),
        F.col("_opened.price").alias("entry_price"),
        "exit_price",
        "quantity",
        (net - spent).alias("pnl"),
        F.try_divide(net - spent, spent).alias("return_pct"),
        (F.col("quantity") * F.col("exit_price") * transaction_fee).alias("fees"),
    )
    return rows.select(
        *keys,
        "timestamp",
        F.col("close").alias("price"),
        "equity",
        F.coalesce(F.try_divide(F.col("equity") - F.col("_peak"), F.col("_peak")), F.lit(0.0)).alias("drawdown"),
        F.when(F.col(POS) > 0, F.try_divide("equity", "_equity_before") - 1).alias("bar_return"),
        "long",
        F.when(F.col("_enter"), "buy").when(F.col("_leave"), "sell").alias("side"),
        F.col("_price").alias("exec_price"),
        F.when(F.col("_leave") | last_open, trade).alias("trade"),
        F.col(POS).alias("bar_no"),
        F.col(TOTAL).alias("bars"),
    )


def equity_curve(run: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return run.select(*keys, "timestamp", "equity", "price")


def drawdowns(run: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return run.select(*keys, "timestamp", "drawdown")


def trades(run: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return run.filter(F.col("trade").isNotNull()).select(*keys, "trade.*")


def markers(run: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars with a buy or sell fill and the price before slippage."""
    return run.filter(F.col("side").isNotNull()).select(*keys, "timestamp", F.col("exec_price").alias("price"), "side")


def metrics(
    run: DataFrame,
    initial_capital: float = 10_000.0,
    periods_per_year: float = 252.0,
    keys: Sequence[str] = KEYS,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Return, Sharpe, drawdown and trade statistics: one combinable aggregate. `also` adds aggregates by name."""
    pnl = F.col("trade.pnl")
    won, lost = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, -pnl))
    out = run.groupBy(*keys).agg(
        F.max_by("equity", "bar_no").alias("final_capital"),
        F.avg("bar_return").alias("_mean"),
        F.stddev_samp("bar_return").alias("_std"),
        F.min("drawdown").alias("maximum_drawdown"),
        F.count(pnl).alias("number_of_trades"),
        F.count_if(pnl > 0).alias("_wins"),
        F.coalesce(won, F.lit(0.0)).alias("_won"),
        F.coalesce(lost, F.lit(0.0)).alias("_lost"),
        *[c.alias(name) for name, c in (also or {}).items()],
    )
    sharpe = F.when(F.col("_std") > 0, F.sqrt(F.lit(float(periods_per_year))) * F.col("_mean") / F.col("_std"))
    factor = (
        F.when(F.col("_lost") > 0, F.try_divide("_won", "_lost")).when(F.col("_won") > 0, 99.99).otherwise(0.0)
    )
    return out.select(
        *keys,
        (F.col("final_capital") / float(initial_capital) - 1).alias("total_return"),
        "final_capital",
        F.coalesce(F.try_divide("_wins", "number_of_trades"), F.lit(0.0)).alias("win_rate"),
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe_ratio"),
        "maximum_drawdown",
        "number_of_trades",
        factor.alias("profit_factor"),
        *(also or {}),
    )


def long_enough(bars: DataFrame, minimum: int = 60) -> DataFrame:
    """Bars of the symbols that have at least `minimum` rows with a close."""
    enough = bars.filter(F.col("close").isNotNull()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return bars.join(enough.filter(F.col("n") >= minimum), "symbol", "left_semi")
