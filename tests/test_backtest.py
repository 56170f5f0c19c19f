"""Backtests and walk-forward runs against a plain row loop written for the test."""

import numpy as np
import pandas as pd
import pytest

from barlake.operators import backtest as bt
from barlake.operators import walkforward as wf
from tests.conftest import collect, make_bars

FEE, SLIP, CAPITAL = 0.001, 0.0005, 10_000.0
QUICK = {"short_window": 3, "long_window": 8}


def loop_signals(close: pd.Series, name: str, p: dict) -> np.ndarray:
    if name == "ma_crossover":
        side = (close.rolling(p["short_window"]).mean() > close.rolling(p["long_window"]).mean()).astype(int)
        return side.diff().fillna(0).to_numpy()
    diff = close.diff()
    wilder = lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    rsi = 100 - 100 / (1 + wilder(diff.clip(lower=0)) / wilder(-diff.clip(upper=0)))
    out, last = [], 0
    for v in rsi:
        now = 1 if v < p.get("lower_threshold", 30) else -1 if v > p.get("upper_threshold", 70) else 0
        out.append(now if now != last else 0)
        last = now or last
    return np.array(out)


def loop_run(rows: pd.DataFrame, name: str, p: dict):
    """Equity per bar and closed trades of one symbol."""
    orders = np.concatenate([[0], loop_signals(rows["close"].reset_index(drop=True), name, p)[:-1]])
    cash, qty, cost, equity, trades = CAPITAL, 0.0, 0.0, [], []
    for order, open_, close in zip(orders, rows["open"], rows["close"]):
        if order > 0 and qty == 0:
            cost = open_ * (1 + SLIP)
            qty, cash = cash / (1 + FEE) / cost, 0.0
        elif order < 0 and qty > 0:
            net = qty * open_ * (1 - SLIP) * (1 - FEE)
            trades.append(net - qty * cost)
            cash, qty = net, 0.0
        equity.append(cash + qty * close)
    if qty > 0:
        trades.append(qty * rows["close"].iloc[-1] * (1 - SLIP) * (1 - FEE) - qty * cost)
    return np.array(equity), trades


@pytest.fixture(scope="module")
def noisy(spark):
    pdf = make_bars(400, symbols=("A", "B", "C"))
    return pdf, spark.createDataFrame(pdf)


RSI = {"lower_threshold": 45, "upper_threshold": 55}


@pytest.mark.parametrize("name,params", [("ma_crossover", QUICK), ("rsi_strategy", RSI)])
@pytest.mark.parametrize("size", [37, None])
def test_matches_a_row_loop(noisy, name, params, size):
    pdf, df = noisy
    run = bt.backtest(df, name, params, block_rows=size)
    got = collect(run, "symbol", "timestamp")
    met = bt.metrics(run).toPandas().set_index("symbol")
    for symbol, rows in pdf.groupby("symbol"):
        equity, trades = loop_run(rows, name, params)
        mine = got[got["symbol"] == symbol]
        np.testing.assert_allclose(mine["equity"], equity, rtol=1e-10)
        peak = np.maximum.accumulate(equity)
        np.testing.assert_allclose(mine["drawdown"], (equity - peak) / peak, atol=1e-10)
        pnl = [t["pnl"] for t in mine["trade"] if t is not None]
        assert len(trades) > 3
        np.testing.assert_allclose(pnl, trades, rtol=1e-7, atol=1e-6)
        m, r = met.loc[symbol], pd.Series(equity).pct_change().dropna()
        assert m["total_return"] == pytest.approx(equity[-1] / CAPITAL - 1)
        assert m["sharpe_ratio"] == pytest.approx(np.sqrt(252) * r.mean() / r.std())
        assert m["maximum_drawdown"] == pytest.approx(((equity - peak) / peak).min())
        assert m["number_of_trades"] == len(trades)
        assert m["win_rate"] == pytest.approx(np.mean([t > 0 for t in trades]))
        won, lost = sum(t for t in trades if t > 0), -sum(t for t in trades if t < 0)
        assert m["profit_factor"] == pytest.approx(won / lost if lost else 99.99)


@pytest.mark.parametrize("name,params", [("ma_crossover", QUICK), ("rsi_strategy", RSI)])
@pytest.mark.parametrize("size", [41, None])
def test_signals(noisy, name, params, size):
    pdf, df = noisy
    got = collect(bt.signals(df, name, params, block_rows=size), "symbol", "timestamp")
    executed = collect(bt.execution(df, name, params, block_rows=size), "symbol", "timestamp")
    for symbol, rows in pdf.groupby("symbol"):
        want = loop_signals(rows["close"].reset_index(drop=True), name, params)
        np.testing.assert_array_equal(got[got["symbol"] == symbol]["signal"], want)
        np.testing.assert_array_equal(executed[executed["symbol"] == symbol]["exec_signal"], np.concatenate([[0], want[:-1]]))


@pytest.mark.parametrize("name,params", [("ma_crossover", QUICK), ("rsi_strategy", RSI)])
def test_no_look_ahead(noisy, name, params):
    _, df = noisy
    cut = df.filter("timestamp <= timestamp'2024-12-01'")
    a = collect(bt.signals(cut, name, params), "symbol", "timestamp")["signal"]
    b = collect(bt.signals(df, name, params).filter("timestamp <= timestamp'2024-12-01'"), "symbol", "timestamp")["signal"]
    pd.testing.assert_series_equal(a, b)


def test_exits_follow_entries(noisy):
    t = bt.trades(bt.backtest(noisy[1], "ma_crossover", QUICK)).toPandas()
    assert len(t) and (t["exit_time"] >= t["entry_time"]).all()
    sides = collect(bt.markers(bt.backtest(noisy[1], "ma_crossover", QUICK)), "symbol", "timestamp")
    for _, s in sides.groupby("symbol"):
        assert (s["side"].to_numpy() == np.array(["buy", "sell"] * len(s))[: len(s)]).all()


def test_no_trades_gives_flat_equity(spark):
    df = spark.createDataFrame(make_bars(30))
    m = bt.metrics(bt.backtest(df, "ma_crossover")).first()
    assert (m["total_return"], m["sharpe_ratio"], m["win_rate"], m["profit_factor"], m["number_of_trades"]) == (0, 0, 0, 0, 0)


def test_bad_arguments(noisy):
    with pytest.raises(ValueError):
        bt.backtest(noisy[1], "unknown")
    with pytest.raises(ValueError):
        bt.backtest(noisy[1], "ma_crossover", initial_capital=0)
    assert bt.long_enough(noisy[1], 401).count() == 0


def test_own_strategy(noisy):
    """A user rule is a function of blocks; here: buy on every rise, sell on every fall."""
    from pyspark.sql import functions as F

    bt.STRATEGIES["momentum"] = bt.Strategy(
        lambda b, p: b.add({"_raw": F.coalesce(F.signum(F.col("close") - b.lag("close")), F.lit(0.0))}), lambda p: 1
    )
    try:
        assert bt.trades(bt.backtest(noisy[1], "momentum")).count() > 100
    finally:
        del bt.STRATEGIES["momentum"]


@pytest.mark.parametrize("size", [50, None])
def test_walk_forward_matches_one_loop_per_window(noisy, size):
    pdf, df = noisy
    plan = wf.WalkForward(train_days=120, test_days=45, step_days=30)
    got = collect(wf.walk_forward(df, "ma_crossover", QUICK, plan, block_rows=size), "symbol", "window_id")
    for symbol, rows in pdf.groupby("symbol"):
        start, end = rows["timestamp"].min(), rows["timestamp"].max()
        windows, k = [], 0
        while start + pd.Timedelta(days=120 + 30 * k) < end:
            train_end = start + pd.Timedelta(days=120 + 30 * k)
            test_start = train_end + pd.Timedelta(days=1)
            windows.append((train_end, test_start, min(test_start + pd.Timedelta(days=45), end)))
            k += 1
        mine = got[got["symbol"] == symbol].reset_index(drop=True)
        assert len(mine) == len(windows)
        for i, (train_end, a, b) in enumerate(windows):
            train = rows[rows["timestamp"] <= train_end]
            test = rows[(rows["timestamp"] >= a) & (rows["timestamp"] <= b)]
            assert (mine["train_bars"][i], mine["test_bars"][i]) == (len(train), len(test))
            ok = len(train) >= 60 and len(test) >= 20
            assert mine["passed"][i] == ok
            if not ok:
                assert np.isnan(mine["test_return"][i]) and mine["error"][i]
                continue
            assert mine["train_return"][i] == pytest.approx(loop_run(train, "ma_crossover", QUICK)[0][-1] / CAPITAL - 1)
            equity, trades = loop_run(test, "ma_crossover", QUICK)
            assert mine["test_return"][i] == pytest.approx(equity[-1] / CAPITAL - 1)
            assert mine["test_num_trades"][i] == len(trades)
    s = wf.summary(wf.walk_forward(df, "ma_crossover", QUICK, plan)).toPandas().set_index("symbol")
    a = got[(got["symbol"] == "A") & got["passed"]]
    assert s.loc["A", "passed_windows"] == len(a)
    assert s.loc["A", "test_return_std"] == pytest.approx(a["test_return"].std(ddof=0))
    assert s.loc["A", "overfitting_ratio"] == pytest.approx(a["train_return"].mean() / a["test_return"].mean())
