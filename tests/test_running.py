"""Running quantile against numpy over every prefix."""

import numpy as np
import pandas as pd
import pytest

from barlake.plans.running import running_quantile
from barlake.plans.series import as_of


def frame(n, seed, ties):
    r = np.random.default_rng(seed)
    hot = np.cumsum(r.normal(size=n)) if not ties else r.integers(0, 4, n).astype(float)
    hot[r.random(n) < 0.1] = np.nan
    parts = [("HOT", hot), ("ONE", np.array([3.0])), ("NONE", np.array([np.nan, np.nan])), ("UP", np.arange(40.0)), ("DOWN", -np.arange(40.0))]
    return pd.concat([pd.DataFrame({"symbol": s, "timestamp": pd.date_range("2024-01-01", periods=len(v), freq="h"), "x": v}) for s, v in parts])


@pytest.mark.parametrize("p", [0.75, 0.0, 1.0, 0.333])
@pytest.mark.parametrize("ties", [False, True])
def test_equals_every_prefix(spark, p, ties):
    pdf = frame(900, 5, ties)
    # blocks of 50 rows: the hot symbol is eighteen of them
    got = running_quantile(spark.createDataFrame(pdf), "x", p, block_rows=50).toPandas()
    want = []
    for symbol, g in pdf.dropna().groupby("symbol"):
        v = g["x"].to_numpy()
        want += [(symbol, t, np.quantile(v[: i + 1], p)) for i, t in enumerate(g["timestamp"])]
    want = pd.DataFrame(want, columns=["symbol", "timestamp", "w"])
    both = want.merge(got, on=["symbol", "timestamp"])
    assert len(both) == len(want) == len(got)
    assert np.allclose(both["w"], both["quantile"], rtol=1e-12, atol=1e-12)


def test_no_rows(spark):
    none = spark.createDataFrame([], "symbol string, timestamp timestamp, x double")
    assert running_quantile(none, "x", 0.5).count() == 0


def test_as_of_takes_the_newest_value_that_is_there(spark):
    t = lambda d: pd.Timestamp(f"2024-01-{d:02d}").to_pydatetime()
    left = spark.createDataFrame(pd.DataFrame({"symbol": "A", "timestamp": [t(1), t(3), t(5), t(9)]}))
    right = spark.createDataFrame([(t(2), 1.0, None), (t(4), None, 7.0), (t(8), 2.0, None)], "timestamp timestamp, a double, b double")
    got = as_of(left, right, ["a", "b"]).toPandas().sort_values("timestamp")
    assert got["a"].fillna(-1).tolist() == [-1, 1, 1, 2] and got["b"].fillna(-1).tolist() == [-1, -1, 7, 7]
