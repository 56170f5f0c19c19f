"""Splits, least squares and autoregression against numpy."""

import numpy as np
import pandas as pd
import pytest

from barlake.operators import forecast as fc
from barlake.plans.gold import gold_rows
from barlake.schemas import FORECAST_FEATURES
from tests.conftest import collect, make_bars


@pytest.fixture(scope="module")
def data(spark):
    pdf = make_bars(400, symbols=("A", "B"))
    return pdf, spark.createDataFrame(pdf)


def test_split_is_chronological(data):
    got = collect(fc.chronological_split(data[1]), "symbol", "timestamp")
    a = got[got["symbol"] == "A"]
    assert a["split"].value_counts().to_dict() == {"train": 280, "validation": 60, "test": 60}
    ends = a.groupby("split")["timestamp"].agg(["min", "max"])
    assert ends.loc["train", "max"] < ends.loc["validation", "min"] and ends.loc["validation", "max"] < ends.loc["test", "min"]
    with pytest.raises(Exception):
        fc.chronological_split(data[1].limit(10)).collect()
    with pytest.raises(ValueError):
        fc.chronological_split(data[1], 0.5, 0.1, 0.1)


def test_linear_model_predicts_like_numpy(data):
    rows = gold_rows(data[1])
    model = fc.train_linear(rows)
    got = collect(model["predictions"], "symbol", "timestamp")
    runs = model["runs"].toPandas().set_index("symbol")
    table = collect(fc.chronological_split(fc.supervised(rows)), "symbol", "timestamp")
    for symbol, t in table.groupby("symbol"):
        train, test = t[t["split"] == "train"], t[t["split"] == "test"]
        mean, std = train[FORECAST_FEATURES].mean(), train[FORECAST_FEATURES].std(ddof=0)
        x = np.column_stack([np.ones(len(train)), (train[FORECAST_FEATURES] - mean) / std])
        w = np.linalg.lstsq(x, train["target_close_next"], rcond=1e-10)[0]
        want = np.column_stack([np.ones(len(test)), (test[FORECAST_FEATURES] - mean) / std]) @ w
        mine = got[got["symbol"] == symbol]
        np.testing.assert_allclose(mine["predicted"], want, rtol=1e-6)
        error = test["target_close_next"].to_numpy() - want
        assert runs.loc[symbol, "mae"] == pytest.approx(np.abs(error).mean(), rel=1e-5)
        assert runs.loc[symbol, "rmse"] == pytest.approx(np.sqrt((error**2).mean()), rel=1e-5)
        assert runs.loc[symbol, "rmse"] >= runs.loc[symbol, "mae"] > 0
    recent = fc.predict_linear(rows, model["stats"], model["coefficients"], 30)
    assert recent.groupBy("symbol").count().filter("count = 30").count() == 2


def plain_ar(close, p=5):
    train = close[: int(len(close) * 0.7)]
    y = np.diff(train)
    x = np.column_stack([y[p - i - 1 : len(y) - i - 1] for i in range(p)])
    w = np.linalg.lstsq(x, y[p:], rcond=None)[0]
    return train, y, w


def test_autoregression(data):
    model = fc.train_ar(data[1])
    got = collect(model["predictions"], "symbol", "step")
    fitted = collect(fc.ar_fitted(model["frame"], model["coefficients"]), "symbol", "timestamp")
    runs = model["runs"].toPandas().set_index("symbol")
    for symbol, rows in data[0].groupby("symbol"):
        close = rows["close"].to_numpy()
        train, y, w = plain_ar(close)
        history, level, path = list(y), train[-1], []
        for _ in range(60):
            nxt = sum(w[i] * history[-1 - i] for i in range(5))
            history.append(nxt)
            level += nxt
            path.append(level)
        mine = got[got["symbol"] == symbol]
        np.testing.assert_allclose(mine["predicted"], path, rtol=1e-9)
        np.testing.assert_allclose(mine["actual"], close[-60:])
        np.testing.assert_allclose(mine["previous"].iloc[0], train[-1])
        np.testing.assert_allclose(mine["previous"].iloc[1:], close[-60:-1])
        assert runs.loc[symbol, "mae"] == pytest.approx(np.abs(close[-60:] - path).mean())
        one = [train[t] + sum(w[i] * y[t - 1 - i] for i in range(5)) for t in range(5, len(train) - 1)]
        np.testing.assert_allclose(fitted[fitted["symbol"] == symbol]["fitted"].to_numpy()[-len(one):], one, rtol=1e-9)


def test_long_path_pieces_agree(data, monkeypatch):
    frame = fc.ar_frame(data[1])
    w = fc.ar_fit(frame)
    whole = collect(fc.ar_path(frame, w, 100), "symbol", "step")
    monkeypatch.setattr(fc, "PATH_STEPS", 7)
    pieces = collect(fc.ar_path(frame, w, 100), "symbol", "step")
    np.testing.assert_allclose(whole["predicted"], pieces["predicted"], rtol=1e-12)


def test_second_differences(data):
    frame = fc.ar_frame(data[1], lags=2, differences=2)
    w = fc.ar_fit(frame, 2)
    got = collect(fc.ar_path(frame, w, 10, 2, 2), "symbol", "step")
    rows = w.collect()[0]
    close = data[0][data[0]["symbol"] == rows["symbol"]]["close"].to_numpy()[:280]
    d2, d1, level, path = list(np.diff(close, 2)), np.diff(close)[-1], close[-1], []
    for _ in range(10):
        nxt = rows["weights"][0] * d2[-1] + rows["weights"][1] * d2[-2]
        d2.append(nxt)
        d1 += nxt
        level += d1
        path.append(level)
    np.testing.assert_allclose(got[got["symbol"] == rows["symbol"]]["predicted"], path, rtol=1e-9)


def test_minmax_round_trip(data):
    rows = fc.chronological_split(data[1])
    stats = fc.minmax_stats(rows.filter("split = 'train'"), ["close"])
    got = fc.minmax_scale(rows, stats, ["close"]).withColumn("back", fc.minmax_inverse("close_scaled", "close")).toPandas()
    np.testing.assert_allclose(got["back"], got["close"])
    train = got[got["split"] == "train"]["close_scaled"]
    assert train.min() == 0 and train.max() == 1


def test_sequences(data):
    got = fc.sequences(data[1], ["close", "volume"], "target_close_next", 30)
    assert got.groupBy("symbol").count().filter("count = 370").count() == 2
    cut = fc.sequences(data[1], ["close", "volume"], "target_close_next", 30, block_rows=40)
    assert got.exceptAll(cut).count() == 0


def test_future_times(spark):
    pdf = pd.DataFrame({"symbol": "X", "timestamp": pd.bdate_range("2024-01-01", "2024-01-12")})
    got = collect(fc.future_times(spark.createDataFrame(pdf), 3), "step")
    assert got["timestamp"].dt.strftime("%m-%d").tolist() == ["01-15", "01-16", "01-17"]


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("A", 1.0, 1.0, 1.0), ("A", 0.0, 1.0, 0.0)], "symbol string, actual double, predicted double, previous double")
    row = fc.forecast_metrics(df).first()
    assert row["directional_accuracy"] == 0.0 and row["mape"] == pytest.approx(100 * (0 + 1 / 1e-8) / 2)
