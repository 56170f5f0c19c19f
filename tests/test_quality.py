"""Checks, quarantine, keep-last with many copies, gate."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.operators import quality as q
from barlake.operators import select as s
from tests.conftest import collect, make_bars


@pytest.fixture()
def clean(spark):
    return spark.createDataFrame(make_bars(10)).withColumn("batch_seq", F.lit(0))


def broken(spark):
    pdf = make_bars(10)
    pdf.loc[0, "high"] = pdf.loc[0, "low"] - 1
    pdf.loc[2, "volume"] = -5
    pdf.loc[4, "open"] = None
    pdf["batch_seq"] = range(10)
    again = pdf.iloc[[6]].assign(batch_seq=20)
    return spark.createDataFrame(pd.concat([pdf, again]))


def test_clean_bars_have_no_issues(clean):
    row = q.validate(clean).first()
    assert (row["missing_count"], row["duplicate_count"], row["invalid_ohlc_count"], row["invalid_volume_count"]) == (0, 0, 0, 0)
    assert q.silver_quality(clean).first()["quality_status"] == "passed"


def test_each_issue_is_found(spark):
    df = broken(spark)
    row = q.silver_quality(df).first()
    assert (row["source_count"], row["record_count"], row["duplicate_count"]) == (11, 7, 1)
    assert (row["missing_count"], row["invalid_ohlc_count"], row["invalid_volume_count"], row["error_count"]) == (1, 2, 1, 4)
    assert row["quality_status"] == "warning"
    reasons = sorted(r["error_reason"] for r in q.quarantine(df).collect())
    assert reasons == ["duplicate;", "invalid_ohlc;", "invalid_volume;", "missing;invalid_ohlc;"]
    assert q.silver(df).count() == 7


def test_invalid_last_arrival_keeps_the_valid_earlier_one(spark):
    pdf = make_bars(1)
    bad = pdf.assign(volume=-1.0, batch_seq=2)
    df = spark.createDataFrame(pd.concat([pdf.assign(batch_seq=1), bad]))
    assert q.silver(df).first()["volume"] > 0
    reasons = sorted(r["error_reason"] for r in q.quarantine(df).collect())
    assert reasons == ["duplicate;", "invalid_volume;"]
    assert q.silver_quality(df).first()["error_count"] == 2


def test_equal_copies_are_counted_not_lost(spark):
    """5,000 equal copies of one bar, and invalid copies of another."""
    pdf = make_bars(3)
    pdf.loc[1, "volume"] = -1
    copies = pd.concat([pdf, *[pdf.iloc[[0]]] * 4999, *[pdf.iloc[[1]]] * 2])
    df = spark.createDataFrame(copies.assign(batch_seq=0))
    assert q.silver(df).count() == 2
    got = {r["error_reason"]: r["count"] for r in q.quarantine(df).groupBy("error_reason").count().collect()}
    assert got == {"duplicate;": 4999, "invalid_volume;duplicate;": 2, "invalid_volume;": 1}
    assert q.silver_quality(df).first()["error_count"] == 5002


def test_schema_and_coercion(spark):
    pdf = make_bars(2).astype({"open": str})
    pdf.loc[0, "open"] = "broken"
    got = collect(q.conform(spark.createDataFrame(pdf.assign(symbol="aapl"))), "timestamp")
    assert pd.isna(got["open"][0]) and got["open"][1] > 0 and (got["symbol"] == "AAPL").all()
    with pytest.raises(ValueError):
        q.conform(spark.createDataFrame(pdf.drop(columns="close")))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame(make_bars(1)).withColumn("close", F.lit(float("nan")))
    assert q.conform(df).first()["close"] is None


def test_gate_stops_only_failing_symbols(spark):
    pdf = make_bars(5, symbols=("AAPL", "MSFT"))
    pdf.loc[0, "high"] = 0.0
    df = spark.createDataFrame(pdf)
    expected = spark.createDataFrame([("AAPL",), ("MSFT",), ("NONE",)], "symbol string")
    report = q.quality_report(df, expected)
    assert {r["symbol"]: r["quality_status"] for r in report.collect()} == {"AAPL": "failed", "MSFT": "passed", "NONE": "failed"}
    assert {r["symbol"] for r in q.passed_only(df, report).collect()} == {"MSFT"}


def test_layer_choice_and_new_rows(spark, bars):
    gold = bars.filter("symbol = 'AAPL'")
    got = s.history(gold, bars.filter("symbol = 'MSFT'"), bars)
    assert {(r["symbol"], r["layer"]) for r in got.select("symbol", "layer").distinct().collect()} == {
        ("AAPL", "gold"), ("MSFT", "silver"), ("TSLA", "bronze"),
    }
    seen = bars.filter("symbol <> 'TSLA' AND timestamp < timestamp'2024-06-01'")
    assert s.new_rows(bars, seen).filter("symbol = 'TSLA'").count() == 220


def test_time_filter_reaches_the_scan(spark, bars, tmp_path):
    bars.write.parquet(str(tmp_path / "b"))
    df = s.in_range(spark.read.parquet(str(tmp_path / "b")), "2024-03-01", "2024-04-01").select("close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "ReadSchema: struct<timestamp:timestamp,close:double>" in plan


def test_latest_change_single_bar(spark):
    row = s.latest_change(spark.createDataFrame(make_bars(1))).first()
    assert row["change_pct"] == 0.0
