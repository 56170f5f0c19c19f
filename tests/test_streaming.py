"""File-source streams: ingest, late and repeated rows, resampling, alerts, messages."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.operators.resample import resample, resample_one, ticks_to_bars
from barlake.plans.gold import gold_rows
from barlake.sources.tables import Lake
from barlake.streaming import bars as sb
from barlake.streaming import ingest, sinks, sources
from tests.conftest import collect, make_bars


def hourly(rows=240, symbols=("AAPL", "MSFT")):
    pdf = make_bars(rows, symbols=symbols)
    pdf["timestamp"] = pdf.groupby("symbol").cumcount().map(lambda i: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i))
    return pdf


@pytest.fixture()
def landing(spark, tmp_path):
    """Ten files in time order; the last one repeats a row and brings a late corrected one."""
    pdf = hourly()
    times = sorted(pdf["timestamp"].unique())
    for i in range(10):
        part = pdf[pdf["timestamp"].isin(times[i * 24 : (i + 1) * 24])]
        if i == 9:
            late = pdf.iloc[[3]].assign(close=pdf.iloc[3]["open"], ingestion_time=pd.Timestamp("2025-01-01"))
            part = pd.concat([part, part.iloc[[0]], late])
        spark.createDataFrame(part).select(sources.BAR.names).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i:02d}"))
    return pdf, f"{tmp_path}/in/*", tmp_path


def finish(query):
    query.awaitTermination(240)
    assert query.exception() is None


def test_stream_ingest_equals_batch(spark, landing):
    pdf, path, tmp = landing
    lake = Lake(spark, str(tmp / "lake"))
    seen, failed = [], []

    def hook(batch, batch_id):
        seen.append(batch.count())

    def bad_hook(batch, batch_id):
        failed.append(batch_id)
        raise RuntimeError("user error")

    stream = sources.bar_files(spark, path, per_batch=5)
    finish(ingest.start(stream, ingest.bar_ingest(lake, [bad_hook, hook]), str(tmp / "cp")))
    assert sum(seen) == 482 and failed
    silver = collect(lake.read("silver"), "symbol", "timestamp")
    assert len(silver) == 480
    corrected = silver[(silver["symbol"] == "AAPL") & (silver["timestamp"] == pdf.iloc[3]["timestamp"])]
    assert corrected["close"].iloc[0] == pdf.iloc[3]["open"]
    # a second bounded run has nothing new
    finish(ingest.start(sources.bar_files(spark, path, per_batch=5), ingest.bar_ingest(lake), str(tmp / "cp")))
    assert lake.read("bronze").count() == 480


def test_tumbling_bars_equal_batch(spark, landing):
    pdf, path, tmp = landing
    stream = sb.tumble(sources.bar_files(spark, path, per_batch=2), "1 day", repeats=True)
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp / "days")).option("checkpointLocation", str(tmp / "cp2"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    finish(query)
    got = collect(spark.read.parquet(str(tmp / "days")), "symbol", "timestamp")
    want = collect(resample_one(spark.createDataFrame(pdf), "1 day"), "symbol", "timestamp")
    # the last buckets wait for the watermark
    want = want[want["timestamp"] <= got["timestamp"].max()].reset_index(drop=True)
    assert len(got) >= 16
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_high_water_mark(spark, tmp_path):
    lake, out = Lake(spark, str(tmp_path / "lake")), []
    sink = ingest.only_new(lake, lambda df, i: out.append(df.count()))
    pdf = hourly(10)
    sink(spark.createDataFrame(pdf[pdf["timestamp"] < "2024-01-01 06:00"]), 0)
    sink(spark.createDataFrame(pdf), 1)
    sink(spark.createDataFrame(pdf), 1)  # replay of the same batch
    sink(spark.createDataFrame(pdf), 2)
    assert out == [12, 8, 8, 0]


def test_families(spark, landing):
    _, path, tmp = landing
    news = spark.createDataFrame([("AAPL", "title")], "symbol string, title string")
    news.write.parquet(str(tmp / "news"))
    lake = Lake(spark, str(tmp / "lake2"))
    streams = {
        "ohlcv": sources.bar_files(spark, path, per_batch=10),
        "news": sources.bar_files(spark, str(tmp / "news"), news.schema),
    }
    for q in ingest.start_families(lake, streams, str(tmp / "cps")).values():
        finish(q)
    assert lake.read_log("bronze_news").count() == 1 and lake.read("silver").count() == 480


def test_messages_round_trip(spark, tmp_path):
    pdf = make_bars(5)
    out = sinks.bar_messages(spark.createDataFrame(pdf))
    lines = [r["value"] for r in out.collect()] + ["no json", json.dumps({"symbol": "X", "timestamp": "2024-01-01", "open": "bad", "close": 1})]
    lines.append(json.dumps({"symbol": "env", "bars": [{"timestamp": "2024-01-01", "close": 2}, {"timestamp": "2024-01-02", "close": 3}]}))
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.txt").write_text("\n".join(lines))
    stream = sources.decode_bars(sources.message_files(spark, str(tmp_path / "m")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    finish(q)
    got = collect(spark.read.parquet(str(tmp_path / "o")), "symbol", "timestamp")
    assert got["symbol"].value_counts().to_dict() == {"AAPL": 5, "ENV": 2, "X": 1}
    pd.testing.assert_series_equal(got[got["symbol"] == "AAPL"]["close"].reset_index(drop=True), pdf["close"], check_names=False)
    assert pd.isna(got[got["symbol"] == "X"]["open"].iloc[0])
    text = spark.read.text(str(tmp_path / "m"))
    assert sources.undecodable(text).count() == 1
    assert {r["topic"] for r in sinks.all_messages({"ohlcv": spark.createDataFrame(pdf), "index": spark.createDataFrame(pdf)}).collect()} == {"stock-ohlcv-raw", "stock-index"}
    options = sources.broker_options("h:1", ["a", "b"], per_batch=100)
    assert options["subscribe"] == "a,b" and options["maxOffsetsPerTrigger"] == "100"


def test_alerts_and_enrichment(spark, landing):
    pdf, path, tmp = landing
    rules = spark.createDataFrame([("AAPL", "above", 1.0), ("MSFT", "below", 1.0)], "symbol string, condition string, threshold double")
    features = gold_rows(spark.createDataFrame(pdf)).select("symbol", "timestamp", "sma_20")
    for name, stream in {
        "alerts": sb.stream_alerts(sources.bar_files(spark, path, per_batch=10), rules),
        "rich": sb.enrich(sources.bar_files(spark, path, per_batch=10), features),
    }.items():
        q = stream.writeStream.format("parquet").option("path", str(tmp / name)).option("checkpointLocation", str(tmp / f"{name}_cp")).trigger(availableNow=True).start()
        finish(q)
    assert spark.read.parquet(str(tmp / "alerts")).groupBy("symbol").count().collect()[0]["symbol"] == "AAPL"
    rich = spark.read.parquet(str(tmp / "rich"))
    assert rich.count() == 482 and rich.filter("sma_20 IS NULL").count() == 0


def test_resample_buckets(spark):
    ticks = spark.createDataFrame(
        [("A", "2024-01-01 00:00:00", 1, 5.0), ("A", "2024-01-01 00:04:59", 2, 7.0), ("A", "2024-01-01 00:04:59", 3, 6.0), ("A", "2024-01-01 00:05:00", 4, 1.0)],
        "symbol string, timestamp string, tick_id long, price double",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    got = {(r["interval"], str(r["timestamp"])[11:16]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in resample(ticks_to_bars(ticks)).collect()}
    assert got[("5m", "00:00")] == (5, 7, 5, 6, 3) and got[("5m", "00:05")] == (1, 1, 1, 1, 1)
    assert got[("15m", "00:00")] == got[("1h", "00:00")] == got[("1d", "00:00")] == (5, 7, 1, 1, 4)


def test_triggers():
    assert ingest.trigger_options() == {"availableNow": True}
    assert ingest.trigger_options(every="300 seconds") == {"processingTime": "300 seconds"}
