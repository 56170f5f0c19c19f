"""Strategies, backtests and walk-forward windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.catalog import sqlparts  # noqa: F401  (defines the views used below)
from barlake.catalog.base import query
from barlake.operators import backtest as bt
from barlake.operators import walkforward as wf
from barlake.plans.views import NEEDS, SQL

FEE, SLIP, CAPITAL = 0.001, 0.0005, 10000


def _mean(n: int, w: str) -> str:
    frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) OVER {frame} = {n} THEN avg(close) OVER {frame} END"


def backtest_views(name: str, source: str, part: str, short: int = 20, long: int = 50, raw: str | None = None) -> None:
    """Define views `{name}sig` (signals), `{name}` (rows) and `{name}met` (metrics) over bars of `source`."""
    w = f"PARTITION BY {part} ORDER BY timestamp"
    SQL[f"{name}sig"] = raw or f"""SELECT *, coalesce(side - lag(side) OVER ({w}), 0) AS signal FROM (SELECT *,
        CASE WHEN coalesce(({_mean(short, w)}) > ({_mean(long, w)}), false) THEN 1 ELSE 0 END AS side FROM {source})"""
    run = f"({w} ROWS UNBOUNDED PRECEDING)"
    SQL[name] = f"""SELECT *, coalesce((equity - max(equity) OVER {run}) / max(equity) OVER {run}, 0) AS drawdown,
        equity / lag(equity) OVER ({w}) - 1 AS bar_return,
        CASE WHEN leaves OR (islast AND long) THEN qty * xp * {1 - FEE} - qty * ep END AS pnl,
        CASE WHEN leaves OR (islast AND long) THEN (qty * xp * {1 - FEE} - qty * ep) / (qty * ep) END AS return_pct
      FROM (SELECT *, {CAPITAL} * growth * CASE WHEN long THEN close ELSE 1 END AS equity,
        CASE WHEN islast AND long THEN close * {1 - SLIP} ELSE px * {1 - SLIP} END AS xp,
        {CAPITAL} * CASE WHEN islast AND long THEN growth ELSE lag(growth) OVER ({w}) END AS qty,
        last_value(CASE WHEN enters THEN timestamp END IGNORE NULLS) OVER {run} AS entry_time,
        last_value(CASE WHEN enters THEN px * {1 + SLIP} END IGNORE NULLS) OVER {run} AS ep
      FROM (SELECT *, coalesce(product(CASE WHEN enters THEN 1 / ({1 + FEE} * (px * {1 + SLIP}))
        WHEN leaves THEN px * {1 - SLIP} * {1 - FEE} END) OVER {run}, 1) AS growth,
        sum(CASE WHEN enters THEN 1 ELSE 0 END) OVER {run} AS trade_id
      FROM (SELECT *, long AND NOT was AS enters, was AND NOT long AS leaves
      FROM (SELECT *, coalesce(lag(long) OVER ({w}), false) AS was FROM (
        SELECT *, coalesce(open, close) AS px, row_number() OVER (PARTITION BY {part} ORDER BY timestamp DESC) = 1 AS islast,
        coalesce(last_value(CASE WHEN ex <> 0 THEN sign(ex) END IGNORE NULLS) OVER {run} > 0, false) AS long
      FROM (SELECT *, coalesce(lag(signal) OVER ({w}), 0) AS ex FROM {name}sig))))))"""
    SQL[f"{name}met"] = f"""SELECT *, CASE WHEN sd > 0 THEN sqrt(252.0) * mu / sd ELSE 0 END AS sharpe_ratio,
        final_capital / {CAPITAL} - 1 AS total_return,
        CASE WHEN number_of_trades > 0 THEN wins / number_of_trades ELSE 0.0 END AS win_rate,
        CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 99.99 ELSE 0.0 END AS profit_factor
      FROM (SELECT {part}, max_by(equity, timestamp) AS final_capital, avg(bar_return) AS mu,
        stddev_samp(bar_return) AS sd, min(drawdown) AS maximum_drawdown, count(pnl) AS number_of_trades,
        CAST(count(*) FILTER (pnl > 0) AS DOUBLE) AS wins, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS won,
        coalesce(sum(-pnl) FILTER (pnl < 0), 0) AS lost FROM {name} GROUP BY {part})"""
    need = [*NEEDS.get(source, []), source]
    NEEDS[f"{name}sig"] = need
    NEEDS[name] = [*need, f"{name}sig"]
    NEEDS[f"{name}met"] = [*need, f"{name}sig", name]


# Fixed values of the SQL side: 30/70 thresholds on the 14-bar RSI.
NEEDS["rsisig"] = [*NEEDS["f1ind"], "f1ind"]
backtest_views("ma", "f2", "symbol")
backtest_views(
    "rs",
    "f1ind",
    "symbol",
    raw="""SELECT * EXCLUDE (raw), CASE WHEN raw = coalesce(last_value(nullif(raw, 0) IGNORE NULLS) OVER
    (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 0 ELSE raw END AS signal
    FROM (SELECT *, CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 ELSE 0 END AS raw FROM f1ind)""",
)
NEEDS.pop("rsisig")


def _breakout(b, params):
    """Buy above the highest high of the last n bars, sell below their lowest low."""
    n = int(params.get("window", 20))
    frame = b.w.rowsBetween(-n, -1)
    b = b.add({"_top": F.max("high").over(frame), "_low": F.min("low").over(frame), "_full": F.count("close").over(frame) == n})
    above, below = (F.coalesce(F.col("_full") & c, F.lit(False)) for c in (F.col("close") > F.col("_top"), F.col("close") < F.col("_low")))
    return b.add({"_raw": F.when(above, 1.0).when(below, -1.0).otherwise(0.0)})


@query(
    "x_strat",
    "symbol timestamp:t signal:i",
    """SELECT symbol, timestamp, CASE WHEN n = 20 AND close > top THEN 1 WHEN n = 20 AND close < low THEN -1 ELSE 0 END AS signal FROM (
       SELECT symbol, timestamp, close, max(high) OVER w AS top, min(low) OVER w AS low, count(close) OVER w AS n FROM f2
       WINDOW w AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
    "f2",
)
def x_strat(t):
    """A strategy of the user's own, registered by name."""
    bt.STRATEGIES["channel_breakout"] = bt.Strategy(_breakout, lambda p: int(p.get("window", 20)) + 1)
    return bt.signals(t.f2, "channel_breakout", {"window": 20})


query("w_macross", "symbol timestamp:t signal:i", "SELECT * FROM masig", "masig")(lambda t: bt.signals(t.f2, "ma_crossover"))
query("w_rsisig", "symbol timestamp:t signal:i", "SELECT * FROM rssig", "rssig")(lambda t: bt.signals(t.f1, "rsi_strategy"))
query(
    "w_exec",
    "symbol timestamp:t exec_signal:i",
    "SELECT symbol, timestamp, coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY timestamp), 0) AS exec_signal FROM masig",
    "masig",
)(lambda t: bt.execution(t.f2, "ma_crossover"))


def _ma(t):
    return bt.backtest(t.f2, "ma_crossover")


query("b_equity", "symbol timestamp:t equity:e7 price:2 long", "SELECT *, close AS price FROM ma", "ma")(_ma)
query(
    "b_port",
    "symbol trade_id:i entry_time:t exit_time:t entry_price:6 exit_price:6 quantity:e7 pnl:e7 return_pct:e7",
    """SELECT symbol, trade_id, entry_time, timestamp AS exit_time, ep AS entry_price, xp AS exit_price, qty AS quantity,
       pnl, return_pct FROM ma WHERE pnl IS NOT NULL""",
    "ma",
)(lambda t: bt.trades(_ma(t)))
query(
    "b_mark",
    "symbol timestamp:t price:2 side",
    """SELECT symbol, timestamp, px AS price, CASE WHEN enters THEN 'buy' ELSE 'sell' END AS side FROM ma
       WHERE enters OR leaves""",
    "ma",
)(lambda t: bt.markers(_ma(t)))
query("w_dd", "symbol timestamp:t drawdown:6", "SELECT * FROM ma", "ma")(lambda t: bt.drawdowns(_ma(t)))

_MET = "total_return:e7 final_capital:e7 win_rate:6 sharpe_ratio:6 maximum_drawdown:6 number_of_trades:i profit_factor:e7"


@query(
    "a_btmet",
    f"strategy symbol {_MET}",
    """SELECT 'ma_crossover' AS strategy, symbol, total_return, final_capital, win_rate, sharpe_ratio, maximum_drawdown,
       number_of_trades, profit_factor FROM mamet UNION ALL
       SELECT 'rsi_strategy', symbol, total_return, final_capital, win_rate, sharpe_ratio, maximum_drawdown,
       number_of_trades, profit_factor FROM rsmet""",
    "mamet rsmet",
)
def a_btmet(t):
    runs = {"ma_crossover": t.f2, "rsi_strategy": t.f1}
    out = [bt.metrics(bt.backtest(df, name)).withColumn("strategy", F.lit(name)) for name, df in runs.items()]
    return out[0].unionByName(out[1])


# --- walk-forward ------------------------------------------------------------------------------------

SQL["wfw"] = """SELECT symbol, k AS window_id, s AS train_start, s + to_days(CAST(180 + 20 * k AS INTEGER)) AS train_end,
    s + to_days(CAST(181 + 20 * k AS INTEGER)) AS test_start,
    least(e, s + to_days(CAST(211 + 20 * k AS INTEGER))) AS test_end
    FROM (SELECT *, unnest(range(0, date_diff('day', s, e) // 20 + 1)) AS k
    FROM (SELECT symbol, min(timestamp) AS s, max(timestamp) AS e FROM f2 GROUP BY ALL))
    WHERE s + to_days(CAST(180 + 20 * k AS INTEGER)) < e"""
SQL["wfc"] = """SELECT w.*, (SELECT count(*) FROM f2 b WHERE b.symbol = w.symbol AND b.timestamp BETWEEN train_start AND train_end)
    AS train_bars, (SELECT count(*) FROM f2 b WHERE b.symbol = w.symbol AND b.timestamp BETWEEN test_start AND test_end)
    AS test_bars FROM wfw w"""
SQL["slices"] = """SELECT b.*, window_id FROM f2 b JOIN wfw w ON b.symbol = w.symbol
    AND b.timestamp BETWEEN test_start AND test_end"""
SQL["trains"] = """SELECT b.*, window_id FROM f2 b JOIN wfw w ON b.symbol = w.symbol
    AND b.timestamp BETWEEN train_start AND train_end"""
NEEDS["wfw"] = ["f2"]
NEEDS["wfc"] = NEEDS["slices"] = NEEDS["trains"] = ["f2", "wfw"]
for _name, _short, _long in (("d", 20, 50), ("q", 3, 8)):
    backtest_views(f"te{_name}", "slices", "symbol, window_id", _short, _long)
    backtest_views(f"tr{_name}", "trains", "symbol, window_id", _short, _long)
    SQL[f"wf{_name}"] = f"""SELECT *, CASE WHEN NOT passed THEN 'Insufficient bars in window' END AS error FROM (
        SELECT w.*, w.train_bars >= 60 AND w.test_bars >= 20 AS passed,
        CASE WHEN passed THEN a.total_return END AS train_return, CASE WHEN passed THEN b.total_return END AS test_return,
        CASE WHEN passed THEN b.sharpe_ratio END AS test_sharpe,
        CASE WHEN passed THEN b.maximum_drawdown END AS test_max_drawdown,
        CASE WHEN passed THEN b.win_rate END AS test_win_rate,
        CASE WHEN passed THEN b.number_of_trades END AS test_num_trades FROM wfc w
        LEFT JOIN tr{_name}met a ON a.symbol = w.symbol AND a.window_id = w.window_id
        LEFT JOIN te{_name}met b ON b.symbol = w.symbol AND b.window_id = w.window_id)"""
    _need = ["f2", "wfw", "wfc", "slices", "trains"]
    for _phase in ("tr", "te"):
        _need += [f"{_phase}{_name}sig", f"{_phase}{_name}", f"{_phase}{_name}met"]
    NEEDS[f"wf{_name}"] = _need

query(
    "b_wfwin",
    "symbol window_id:i train_start:t train_end:t test_start:t test_end:t",
    "SELECT * FROM wfw",
    "wfw",
)(lambda t: wf.windows(t.f2))
query("j_range", "symbol window_id:i train_bars:i test_bars:i", "SELECT * FROM wfc", "wfc")(lambda t: wf.slice_counts(t.f2))
_WF = (
    "symbol window_id:i train_start:t train_end:t test_start:t test_end:t train_bars:i test_bars:i passed error "
    "train_return:e7 test_return:e7 test_sharpe:6 test_max_drawdown:6 test_win_rate:6 test_num_trades:i"
)
_QUICK = {"short_window": 3, "long_window": 8}
query("b_wf", _WF, "SELECT * FROM wfq", "wfq")(lambda t: wf.walk_forward(t.f2, "ma_crossover", _QUICK))
_SUM = (
    "symbol params total_windows:i passed_windows:i failed_windows:i avg_train_return:e6 train_return_std:e6 "
    "avg_test_return:e6 test_return_std:e6 avg_test_sharpe:6 avg_test_max_drawdown:6 avg_test_win_rate:6 "
    "total_test_trades:i return_consistency:6 overfitting_ratio:e6"
)
_SUMSQL = """SELECT symbol, '{p}' AS params, count(*) AS total_windows, count(*) FILTER (passed) AS passed_windows,
    count(*) FILTER (NOT passed) AS failed_windows, avg(train_return) AS avg_train_return,
    stddev_pop(train_return) AS train_return_std, avg(test_return) AS avg_test_return,
    stddev_pop(test_return) AS test_return_std, avg(test_sharpe) AS avg_test_sharpe,
    avg(test_max_drawdown) AS avg_test_max_drawdown, avg(test_win_rate) AS avg_test_win_rate,
    coalesce(sum(test_num_trades), 0) AS total_test_trades,
    coalesce(CASE WHEN count(test_return) > 0 THEN count(*) FILTER (test_return > 0) / CAST(count(test_return) AS DOUBLE) END, 0)
    AS return_consistency, CASE WHEN avg(test_return) <> 0 THEN avg(train_return) / avg(test_return) END AS overfitting_ratio
    FROM {v} GROUP BY symbol"""


@query(
    "a_wfsum",
    _SUM,
    _SUMSQL.format(p="20/50", v="wfd") + " UNION ALL " + _SUMSQL.format(p="3/8", v="wfq"),
    "wfd wfq",
)
def a_wfsum(t):
    runs = {"20/50": None, "3/8": _QUICK}
    out = [wf.summary(wf.walk_forward(t.f2, "ma_crossover", p)).withColumn("params", F.lit(n)) for n, p in runs.items()]
    return out[0].unionByName(out[1])
