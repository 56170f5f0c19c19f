"""Block cutting, running aggregates, tails, as-of joins and quantiles against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.plans import series as s
from barlake.plans.quantile import exact_quantile
from tests.conftest import collect, make_bars


@pytest.fixture(scope="module")
def walk(spark):
    """One long and one short series, three bars a day on some days."""
    rng = np.random.default_rng(7)
    parts = []
    for symbol, n in (("LONG", 3000), ("SHORT", 40)):
        parts.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 20, n)), "h"),
                    "close": 100 + np.cumsum(rng.normal(0, 1, n)),
                }
            )
        )
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=1))


def test_positions(walk):
    pdf, df = walk
    got = collect(s.number_rows(df), "symbol", "timestamp")
    want = pdf.sort_values(["symbol", "timestamp"]).reset_index(drop=True)
    assert (got["_pos"] == want.groupby("symbol").cumcount()).all()
    assert (got["_n"] == want.groupby("symbol")["close"].transform("size")).all()


@pytest.mark.parametrize("size", [7, 64, 1000, 100_000])
def test_halo_gives_the_same_windows(walk, size):
    pdf, df = walk
    b = s.series(df, before=50, after=2, block_rows=size)
    b = b.add({"mean": b.rolling(F.avg, "close", 50), "next": b.lead("close", 2), "prev": b.lag("close", 3)})
    got = collect(b.rows(), "symbol", "timestamp")
    by = pdf.sort_values(["symbol", "timestamp"]).reset_index(drop=True).groupby("symbol")["close"]
    np.testing.assert_allclose(got["mean"], by.transform(lambda x: x.rolling(50).mean()), rtol=1e-12)
    np.testing.assert_allclose(got["next"], by.shift(-2), rtol=0)
    np.testing.assert_allclose(got["prev"], by.shift(3), rtol=0)


@pytest.mark.parametrize("size", [500, 100_000])
@pytest.mark.parametrize("span", [2, 9, 26, 200])
def test_recursive_average(walk, size, span):
    pdf, df = walk
    alpha = 2 / (span + 1)
    b = s.series(df, before=s.ema_halo(alpha), block_rows=size)
    got = collect(s.ema(b, {"y": ("close", alpha, 0, span)}).rows(), "symbol", "timestamp")
    by = pdf.sort_values(["symbol", "timestamp"]).reset_index(drop=True).groupby("symbol")["close"]
    want = by.transform(lambda x: x.ewm(span=span, adjust=False, min_periods=span).mean())
    np.testing.assert_allclose(got["y"], want, rtol=1e-12)
    assert (got["y"].isna() == want.isna()).all()


@pytest.mark.parametrize("size", [13, 100_000])
def test_running_aggregates(walk, size):
    pdf, df = walk
    b = s.series(df, block_rows=size)
    every = F.when(F.col("_pos") % 17 == 3, F.col("close"))
    b = s.scan(
        b,
        {
            "total": ("sum", F.col("close")),
            "top": ("max", F.col("close")),
            "low": ("min", F.col("close")),
            "seen": ("last", every),
            "prod": ("product", 1 + F.col("close") / 1e5),
        },
        {"before": "total", "earlier": "seen"},
    )
    got = collect(b.rows(), "symbol", "timestamp")
    pdf = pdf.sort_values(["symbol", "timestamp"]).reset_index(drop=True)
    by = pdf.groupby("symbol")["close"]
    np.testing.assert_allclose(got["total"], by.cumsum(), rtol=1e-12)
    np.testing.assert_allclose(got["before"], (by.cumsum() - pdf["close"]), atol=1e-6)
    np.testing.assert_allclose(got["top"], by.cummax())
    np.testing.assert_allclose(got["low"], by.cummin())
    np.testing.assert_allclose(got["prod"], (1 + pdf["close"] / 1e5).groupby(pdf["symbol"]).cumprod(), rtol=1e-12)
    marked = pdf["close"].where(pdf.groupby("symbol").cumcount() % 17 == 3)
    seen = marked.groupby(pdf["symbol"]).ffill()
    np.testing.assert_allclose(got["seen"], seen)
    np.testing.assert_allclose(got["earlier"], seen.groupby(pdf["symbol"]).shift(1))


def test_tail(walk):
    pdf, df = walk
    got = collect(s.tail_n(df, 45), "symbol", "timestamp")
    want = pdf.sort_values(["symbol", "timestamp"]).groupby("symbol").tail(45).reset_index(drop=True)
    pd.testing.assert_series_equal(got["close"], want["close"], check_names=False)


def test_as_of(walk, spark):
    pdf, df = walk
    right = pd.DataFrame(
        {"timestamp": pd.to_datetime(["2024-01-20 00:00", "2024-01-20 05:00", "2024-03-01 00:00", "2025-06-15 00:00"]), "rate": [1.0, 2.0, 3.0, 4.0]}
    )
    got = collect(s.as_of(df, spark.createDataFrame(right), ["rate"]), "symbol", "timestamp")
    want = pd.merge_asof(pdf.sort_values("timestamp"), right, on="timestamp").sort_values(["symbol", "timestamp"])
    np.testing.assert_allclose(got["rate"], want["rate"])
    assert len(got) == len(pdf)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.75, 1.0])
def test_quantile(spark, p):
    rng = np.random.default_rng(3)
    big = rng.lognormal(0, 2, 60_000)
    big[:25_000] = 1.25  # a third of all rows share one value
    pdf = pd.DataFrame({"symbol": ["BIG"] * len(big) + ["TINY"] * 3 + ["NONE"], "v": [*big, 1.0, 2.0, 4.0, None]})
    got = {r["symbol"]: r["quantile"] for r in exact_quantile(spark.createDataFrame(pdf), "v", p).collect()}
    assert got["BIG"] == pytest.approx(np.quantile(big, p), rel=1e-14)
    assert got["TINY"] == pytest.approx(np.quantile([1, 2, 4], p))
    assert "NONE" not in got


@pytest.mark.parametrize("p", [0.0, 0.5, 0.75, 0.999, 1.0])
def test_quantile_of_awkward_values(spark, p):
    rng = np.random.default_rng(5)
    cases = {
        "CLOSE": 100 + rng.random(20_000) * 1e-9,  # one coarse digit holds them all
        "STEPS": np.arange(10_001.0),
        "SAME": np.full(20_000, -3.5),
        "SIGNS": rng.permutation([*(-np.geomspace(1e-300, 1e300, 501)), *np.zeros(99), *np.geomspace(5e-324, 1e300, 400)]),
        "ENDS": np.array([-np.inf, -1.0, 0.0, 2.0, 3.0, np.inf, np.inf]),
        "TWO": np.array([1.0, np.nextafter(1.0, 2.0)]),
        "ONE": np.array([7.0]),
    }
    pdf = pd.DataFrame([(k, v) for k, values in cases.items() for v in values], columns=["symbol", "v"])
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("ONE", float("nan"))], "symbol string, v double"))
    got = {r["symbol"]: r["quantile"] for r in exact_quantile(df, "v", p).collect()}
    for k, values in cases.items():
        low, high = np.sort(values)[[int(np.floor(p * (len(values) - 1))), int(np.ceil(p * (len(values) - 1)))]]
        share = p * (len(values) - 1) % 1
        want = low + (high - low) * share if high > low else low
        assert got[k] == want or got[k] == pytest.approx(want, rel=1e-14, abs=0), k


def test_no_window_over_a_whole_symbol(walk):
    """Row windows are cut by day or block; only summaries are ordered per symbol."""
    from barlake.plans.gold import gold_rows

    df = walk[1].withColumns({c: F.col("close") for c in ("open", "high", "low", "volume")})
    plan = gold_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "_rows" not in line and "_before" not in line:
            assert "_block#" in line or "_day#" in line, line


def test_groups_are_bounded(walk):
    """No (symbol, block) group is larger than a block and its halo, whatever the length of the symbol."""
    sizes = s.series(walk[1], before=20, after=1, block_rows=100).df.groupBy("symbol", "_block").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 121
    assert sizes.filter("symbol = 'LONG'").count() == 30


def test_bars_helper():
    assert len(make_bars(10)) == 10
