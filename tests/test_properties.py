"""Random inputs: results do not depend on row order, symbol order, partitions, or the cut into blocks."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barlake.operators import backtest as bt
from barlake.operators import quality as q
from barlake.operators.indicators import indicators
from barlake.plans.quantile import exact_quantile
from tests.conftest import collect

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def walk(seed: int, rows: list[int]) -> pd.DataFrame:
    """Symbols of very different length, one of them holding most rows."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, n in enumerate(rows):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        stamps = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 30, n)), "h")
        parts.append(pd.DataFrame({"symbol": f"S{i}", "timestamp": stamps, "open": close * 0.999, "close": close, "volume": 1.0}))
    return pd.concat(parts, ignore_index=True)


@FEW
@given(st.integers(0, 10_000), st.lists(st.integers(1, 120), min_size=1, max_size=3), st.integers(5, 90), st.integers(1, 7),
       st.sampled_from(["hour", "day", "month"]))
def test_indicators_do_not_depend_on_layout(spark, seed, rows, size, partitions, bucket):
    pdf = walk(seed, [*rows, 400])
    plain = collect(indicators(spark.createDataFrame(pdf)), "symbol", "timestamp")
    shuffled = spark.createDataFrame(pdf.sample(frac=1, random_state=seed)).repartition(partitions)
    cut = collect(indicators(shuffled, block_rows=size, bucket=bucket), "symbol", "timestamp")
    pd.testing.assert_frame_equal(plain, cut, rtol=1e-10, atol=1e-10)


@FEW
@given(st.integers(0, 10_000), st.integers(5, 60), st.integers(2, 6), st.integers(7, 15))
def test_backtest_does_not_depend_on_the_cut(spark, seed, size, short, long):
    df = spark.createDataFrame(walk(seed, [30, 350]))
    p = {"short_window": short, "long_window": long}
    columns = ["symbol", "timestamp", "equity", "drawdown", "bar_return", "long", "side"]
    a = collect(bt.backtest(df, "ma_crossover", p).select(columns), "symbol", "timestamp")
    b = collect(bt.backtest(df, "ma_crossover", p, block_rows=size).select(columns), "symbol", "timestamp")
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-12)


@FEW
@given(st.integers(0, 10_000), st.floats(0, 1))
def test_quantile_is_exact(spark, seed, p):
    rng = np.random.default_rng(seed)
    values = np.round(rng.standard_t(2, 30_000), rng.integers(0, 4))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "v": values}))
    got = exact_quantile(df, "v", p).first()["quantile"]
    np.testing.assert_allclose(got, np.quantile(values, p), rtol=1e-12, atol=1e-12)


@FEW
@given(st.integers(0, 10_000))
def test_cleaning_accounts_for_every_row(spark, seed):
    """Silver rows and quarantined rows add up to the input; every key keeps its last valid arrival."""
    rng = np.random.default_rng(seed)
    n = 300
    pdf = pd.DataFrame({"symbol": rng.choice(["A", "B"], n, p=[0.8, 0.2]), "k": rng.integers(0, 25, n), "batch_seq": rng.integers(0, 3, n)})
    pdf["timestamp"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["k"], "D")
    pdf["close"] = rng.choice([10.0, 11.0], n)
    pdf["open"] = pdf["low"] = pdf["close"]
    pdf["high"] = pdf["close"] + rng.choice([0, 0, -1], n)
    pdf["volume"] = rng.choice([1.0, 1.0, -1.0, None], n)
    df = spark.createDataFrame(pdf.drop(columns="k"))
    clean, rejected = q.silver(df), q.quarantine(df)
    valid = pdf[(pdf["high"] >= pdf["close"]) & (pdf["volume"] >= 0)]
    last = valid.groupby(["symbol", "timestamp"])["batch_seq"].max()
    assert collect(clean, "symbol", "timestamp").set_index(["symbol", "timestamp"])["batch_seq"].to_dict() == last.to_dict()
    quality = q.silver_quality(df).agg(F.sum("error_count"), F.sum("source_count"), F.sum("duplicate_count")).first()
    assert rejected.count() == quality[0] and quality[1] == n
    assert rejected.filter(F.contains("error_reason", F.lit("duplicate"))).count() == quality[2]
