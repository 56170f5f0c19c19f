"""Indicators and features: literal values, properties, parity with pandas, independence of the cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.operators import features as ft
from barlake.operators import indicators as ind
from barlake.plans.gold import drop_warmup, gold
from barlake.plans.series import series
from tests.conftest import collect


def frame(spark, values):
    stamps = pd.date_range("2024-01-01", periods=len(values), freq="D")
    return spark.createDataFrame(pd.DataFrame({"symbol": "X", "timestamp": stamps, "close": [float(v) for v in values]}))


def test_sma_literal(spark):
    got = collect(ind.add_sma(series(frame(spark, [1, 2, 3, 4, 5]), before=3), [3]).rows(), "timestamp")["sma_3"]
    assert np.isnan(got[1]) and got[2] == 2.0 and got[4] == 4.0


def test_window_must_be_positive(spark):
    with pytest.raises(ValueError):
        ind.add_sma(series(frame(spark, [1, 2]), before=1), [0])
    with pytest.raises(ValueError):
        ind.span_alpha(0)


def test_ema_leads_sma_in_a_step(spark):
    got = collect(ind.indicators(frame(spark, [10] * 10 + [20] * 10), {"sma": (5,), "ema": (5,)}, ["sma", "ema"]), "timestamp")
    assert got["ema_5"][12] > got["sma_5"][12]


def test_rsi_range_and_extremes(spark):
    up = collect(ind.indicators(frame(spark, np.linspace(100, 140, 40)), families=["rsi"]), "timestamp")["rsi_14"]
    assert up.isna().sum() == 14 and (up.dropna() == 100).all()
    down = collect(ind.indicators(frame(spark, np.linspace(140, 100, 40)), families=["rsi"]), "timestamp")["rsi_14"]
    assert (down.dropna() == 0).all()
    flat = collect(ind.indicators(frame(spark, [5] * 40), families=["rsi"]), "timestamp")["rsi_14"]
    assert flat.isna().all()


def test_bands_are_ordered(spark):
    got = collect(ind.indicators(frame(spark, np.linspace(20, 40, 40) + np.sin(np.arange(40))), families=["bollinger"]), "timestamp")
    got = got.dropna()
    assert (got["bb_upper"] >= got["bb_middle"]).all() and (got["bb_middle"] >= got["bb_lower"]).all()


def pandas_indicators(close: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame({f"sma_{n}": close.rolling(n).mean() for n in (5, 10, 20, 50)})
    ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
    out["ema_12"], out["ema_26"] = ema(close, 12), ema(close, 26)
    diff = close.diff()
    wilder = lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    gain, loss = wilder(diff.clip(lower=0)), wilder(-diff.clip(upper=0))
    out["rsi_14"] = 100 - 100 / (1 + gain / loss)
    out["macd"] = out["ema_12"] - out["ema_26"]
    out["macd_signal"] = ema(out["macd"], 9)
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    out["bb_middle"] = close.rolling(20).mean()
    out["bb_upper"] = out["bb_middle"] + 2 * close.rolling(20).std()
    return out


@pytest.mark.parametrize("size", [90, None])
def test_all_indicators_match_pandas(bars, size):
    got = collect(ind.indicators(bars, block_rows=size), "symbol", "timestamp")
    for _, rows in got.groupby("symbol"):
        want = pandas_indicators(rows["close"].reset_index(drop=True))
        for c in want:
            np.testing.assert_allclose(rows[c].to_numpy(), want[c].to_numpy(), rtol=1e-9, atol=1e-9, err_msg=c)


def test_gold_columns_targets_and_lags(bars):
    got = collect(gold(bars), "symbol", "timestamp")
    for _, rows in got.groupby("symbol"):
        close = rows["close"].reset_index(drop=True)
        rows = rows.reset_index(drop=True)
        np.testing.assert_allclose(rows["target_close_next"], close.shift(-1))
        np.testing.assert_allclose(rows["close_lag_2"], close.shift(2))
        np.testing.assert_allclose(rows["return"], close.pct_change())
        np.testing.assert_allclose(rows["rolling_std_20"], close.pct_change().rolling(20).std())
        q = close.pct_change().rolling(20).std().quantile(0.75)
        assert ((close.pct_change().rolling(20).std() > q) == rows["volatility_actual"]).all()
    assert (got["usd_vnd"] == 25000).all()
    assert set(ft.REGIME_CODES) >= set(got["regime"])


def test_gold_does_not_depend_on_the_cut(bars):
    a = collect(gold(bars), "symbol", "timestamp")
    b = collect(gold(bars, block_rows=70), "symbol", "timestamp")
    pd.testing.assert_frame_equal(a, b, rtol=1e-11)


def test_no_look_ahead(bars):
    """Features of a bar stay the same when later bars are cut off (the regime threshold is full-sample)."""
    cut = bars.filter(F.col("timestamp") <= F.lit("2024-07-01").cast("timestamp"))
    keep = ["symbol", "timestamp", "sma_20", "ema_26", "rsi_14", "macd_signal", "rolling_std_20", "volume_ma_20"]
    a = collect(gold(cut).select(*keep), "symbol", "timestamp")
    b = collect(gold(bars).select(*keep).filter(F.col("timestamp") <= F.lit("2024-07-01").cast("timestamp")), "symbol", "timestamp")
    pd.testing.assert_frame_equal(a, b, rtol=1e-11)


def test_short_series(spark):
    short = frame(spark, range(1, 31)).withColumns({c: F.col("close") for c in ("open", "high", "low", "volume")})
    got = collect(gold(short), "timestamp")
    assert got["sma_50"][:29].isna().all() and got["sma_50"][29] == pytest.approx(15.5)
    assert got["usd_vnd"].isna().all()
    tiny = collect(gold(short.limit(10)), "timestamp")
    assert tiny["regime"].isna().all() and tiny["volatility_20d"].isna().all()


def test_zero_base_gives_null_not_an_error(spark):
    got = collect(ft.add_price_features(series(frame(spark, [0, 1, 2]).withColumn("volume", F.lit(0.0)), before=22)).rows(), "timestamp")
    assert np.isnan(got["return"][1]) and np.isnan(got["volume_change"][2])


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError):
        gold(frame(spark, [1, 2]))


def test_warmup(bars):
    assert drop_warmup(gold(bars), ["sma_50", "macd_signal"]).count() == 3 * (220 - 49)


def test_description(spark):
    row = spark.createDataFrame([(10.0, 9.0, 8.0, 71.0, 9.5, 5.0)], "close double, sma_20 double, sma_50 double, rsi_14 double, bb_upper double, bb_lower double")
    got = row.select(*[c.alias(n) for n, c in ind.describe().items()]).first()
    assert got["trend"].startswith("Price is above") and got["momentum"] == "RSI is 71.00, in the historically elevated zone."
    assert got["volatility"].startswith("Close is above")
    none = row.withColumn("sma_50", F.lit(None).cast("double")).select(ind.describe()["trend"].alias("t")).first()
    assert none["t"] == "insufficient data"


def test_window_one_is_the_series(spark):
    out = collect(ind.add_ema(series(frame(spark, [1.0, 5.0, 2.0, 4.0])), [1, 2]).df, "timestamp")
    assert out["ema_1"].tolist() == [1.0, 5.0, 2.0, 4.0]


def test_unknown_family_raises():
    with pytest.raises(ValueError, match="unknown families"):
        ind.halo({"wma": (5,)})


def test_null_inside_a_series_raises(spark):
    with pytest.raises(Exception, match="null inside the series"):
        gap = frame(spark, [1, 2, 3, 4]).withColumn("close", F.when(F.col("close") != 3, F.col("close")))
        ind.add_ema(series(gap), [3]).df.collect()
