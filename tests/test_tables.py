"""Layers on disk: upsert, versions, partitions, jobs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.plans import jobs
from barlake.sources import tables
from barlake.sources.tables import Lake
from tests.conftest import make_bars


@pytest.fixture()
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def batch(spark, pdf, at):
    return spark.createDataFrame(pdf.assign(ingestion_time=pd.Timestamp(at)))


def test_upsert_versions_and_rollback(spark, lake):
    first = make_bars(60, symbols=("AAPL", "MSFT"))
    lake.append_bronze(batch(spark, first, "2024-06-01"), 1, {"source": "test"})
    fixed = first[first["symbol"] == "AAPL"].head(5).assign(close=1.0)
    lake.append_bronze(batch(spark, fixed, "2024-06-02"), 2)
    now = lake.read("bronze")
    assert now.count() == 120 and now.filter("close = 1.0").count() == 5
    log = lake.read("bronze_log")
    assert tables.as_of_time(log, "2024-06-01 12:00:00").filter("close = 1.0").count() == 0
    assert [r["rows"] for r in tables.snapshots(log).orderBy("snapshot_id").collect()] == [120, 5]
    expired = tables.expired_snapshots(log, "2024-07-01").collect()
    assert [r["snapshot_id"] for r in expired] == [1]
    assert lake.read_log("lineage").filter("run_id = '1'").count() == 2
    lake.rollback(1)
    assert lake.read("bronze").filter("close = 1.0").count() == 0 and lake.read("bronze").count() == 120


def test_replayed_batch_changes_nothing(spark, lake):
    rows = batch(spark, make_bars(30), "2024-06-01")
    lake.append_bronze(rows, 1)
    lake.append_bronze(rows, 1)
    assert lake.read("bronze").count() == 30 and lake.read("bronze_log").count() == 30


def test_partitions_pruning_and_files(spark, lake, tmp_path):
    lake.append_bronze(batch(spark, make_bars(100, symbols=("AAPL", "MSFT")), "2024-06-01"), 1)
    assert (tmp_path / "lake/bronze/symbol=AAPL/year=2024/month=1").is_dir()
    read = lake.read("bronze", "aapl", "2024-02-01", "2024-02-29")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "symbol" in plan.split("PartitionFilters")[1][:400]
    assert {r["month"] for r in read.select("month").distinct().collect()} == {2}
    assert lake.files("bronze").count() == lake.read("bronze").select("symbol", "year", "month").distinct().count()
    # only the partitions in the frame are replaced
    one = lake.read("bronze").filter("symbol = 'AAPL' AND month = 1").limit(1)
    lake.overwrite_partitions("bronze", spark.createDataFrame(one.collect(), one.schema))
    left = {r["symbol"]: r["count"] for r in lake.read("bronze").groupBy("symbol").count().collect()}
    assert left["MSFT"] == 100 and left["AAPL"] < 100


def test_compaction_keeps_rows(spark, lake):
    for i in range(3):
        lake.append("loose", tables.with_partition(spark.createDataFrame(make_bars(40).iloc[i::3])), ("symbol", "year", "month"))
    before = lake.files("loose").count()
    lake.compact("loose", 1_000_000, "loose_staging")
    assert lake.files("loose").count() < before and lake.read("loose").count() == 40


def test_catalog_table(spark, lake):
    lake.append_bronze(batch(spark, make_bars(30), "2024-06-01"), 1)
    lake.write_layer("silver", lake.read("bronze").drop("year", "month", "batch_seq"))
    spark.sql("DROP TABLE IF EXISTS silver_bars")
    lake.create_table("silver_bars", "silver")
    assert spark.table("silver_bars").filter("symbol = 'AAPL'").count() == 30
    spark.sql("DROP TABLE silver_bars")


def test_whole_run(spark, lake):
    pdf = make_bars(300, symbols=("AAPL", "MSFT", "BAD"))
    pdf.loc[pdf["symbol"] == "BAD", "high"] = 0.0
    pdf.loc[5, "volume"] = -1.0
    jobs.ingest(lake, batch(spark, pdf, "2024-06-01"), 1)
    record = {r["symbol"]: r for r in jobs.run(lake, "r1").collect()}
    assert record["AAPL"]["status"] == "completed" and record["AAPL"]["records_processed"] == 299
    assert record["BAD"]["status"] == "failed"
    gold = lake.read("gold")
    assert gold.select("symbol").distinct().count() == 2 and "rsi_14" in gold.columns
    assert lake.read_log("silver_errors").count() == 301
    quality = {r["symbol"]: r["quality_status"] for r in lake.read_log("quality").collect()}
    assert quality == {"AAPL": "passed", "MSFT": "passed", "BAD": "failed"}
    runs = jobs.train(lake, "t1").toPandas()
    assert len(runs) == 2 and (runs["rmse"] >= runs["mae"]).all() and (runs["mae"] > 0).all()
    assert jobs.train(lake, "t2", "arima").count() == 2
    assert {r["model_name"] for r in jobs.trained_models(lake, "aapl").collect()} == {"linear_regression", "arima"}
    assert jobs.predict(lake, "t1", last=30).count() == 60
    assert jobs.predict(lake, "t2", "arima", horizon=5).count() == 10
    assert jobs.run_backtest(lake, "b1", "ma_crossover", {"short_window": 3, "long_window": 8}).count() == 2
    dash = jobs.dashboard(lake).collect()
    assert len(dash) == 2 and dash[0]["latest_pipeline"]["status"] == "completed" and dash[0]["gold_count"] >= 299
    with pytest.raises(ValueError):
        jobs.train(lake, "t3", "lstm")


def test_macro_table(spark, lake):
    fx = spark.createDataFrame([("USD/VND", "2024-01-01", 25000.0)], "currency_pair string, timestamp string, mid_rate double")
    oil = spark.createDataFrame([("WTI_OIL", "2024-01-01", 80.0)], "commodity string, timestamp string, price double")
    jobs.ingest_macro(lake, {"fx": (fx, "currency_pair", "mid_rate"), "oil": (oil, "commodity", "price")}, "m1")
    assert {r["series"] for r in lake.read_log("macro").collect()} == {"USD/VND", "WTI_OIL"}


def test_other_families(spark, lake):
    articles = spark.createDataFrame(
        [("vnm", "Strong buy upgrade", "profit growth", "u", "2024-01-02 10:00:00"), (None, "fraud", "", "u", "2024-01-03 10:00:00")],
        "symbol string, title string, content string, url string, published_date string",
    )
    jobs.ingest_news(lake, articles, "n1")
    jobs.ingest_news(lake, articles, "n1")  # a retry adds nothing
    assert lake.read_log("silver_news").count() == 2
    assert {r["symbol"]: r["article_count"] for r in lake.read_log("gold_sentiment").collect()} == {"VNM": 1, "MARKET": 1}
    jobs.ingest_sentiment(lake, "2024-01-05", "s1")
    assert {r["symbol"]: r["trend"] for r in lake.read_log("sentiment_summary").collect()} == {"VNM": "positive", "MARKET": "negative"}
    record = spark.createDataFrame([("vnm", "2024-01-01", 10.0, "2023-09-30")], "symbol string, timestamp string, pe_ratio double, period string")
    jobs.ingest_fundamentals(lake, record, "f1")
    jobs.ingest_fundamentals(lake, record.withColumns({"timestamp": F.lit("2024-02-01"), "pe_ratio": F.lit(11.0)}), "f2")
    row = jobs.latest_fundamentals(lake).first()
    assert (row["symbol"], row["pe_ratio"], row["year"], row["quarter"]) == ("VNM", 11.0, 2023, 3)
    jobs.write_index_features(lake, spark.createDataFrame(make_bars(30, symbols=("VNINDEX",))), "i1")
    assert lake.read_log("gold_index").first()["index_name"] == "VNINDEX"


def test_two_writers_share_a_batch_number(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.read("bronze").count() == 0
    first = lake.append_bronze(batch(spark, make_bars(5), "2024-06-02"), 0)
    again = make_bars(5).assign(close=lambda d: d["open"])
    second = lake.append_bronze(batch(spark, again.iloc[:2], "2024-06-01"), 0, writer="stream")
    assert (first["received"], first["written"], first["duplicates"]) == (5, 5, 0) and second["received"] == 2
    rows = lake.read("bronze").orderBy("timestamp").toPandas()
    assert len(rows) == 5
    # the later landing wins although its rows carry an earlier time, and a replay of the first batch changes nothing
    assert (rows["close"][:2] == rows["open"][:2]).all() and (rows["close"][2:] != rows["open"][2:]).all()
    lake.append_bronze(batch(spark, make_bars(5), "2024-06-02"), 0)
    assert lake.read("bronze").orderBy("timestamp").toPandas()["close"].tolist() == rows["close"].tolist()


def test_rerun_with_other_rows_replaces_the_batch(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = make_bars(4)
    moved = rows.assign(timestamp=rows["timestamp"] + pd.Timedelta(days=60))
    lake.append_bronze(batch(spark, rows, "2024-06-01"), 1)
    lake.append_bronze(batch(spark, make_bars(6, symbols=("MSFT",)), "2024-06-01"), 1, writer="other")
    jobs.refresh_silver(lake, "a")
    lake.append_bronze(batch(spark, moved, "2024-06-01"), 1)
    jobs.refresh_silver(lake, "b", lake.touched(1))
    for layer in ("bronze_log", "bronze", "silver"):
        got = lake.read(layer).groupBy("symbol").agg(F.count("close").alias("n"), F.min("timestamp").alias("first")).toPandas()
        assert dict(zip(got["symbol"], got["n"])) == {"AAPL": 4, "MSFT": 6}, layer
        assert got.set_index("symbol")["first"]["AAPL"] == moved["timestamp"].min(), layer
    # a rerun without rows takes the batch away, and other writers' rows stay
    lake.append_bronze(batch(spark, rows, "2024-06-01").limit(0), 1)
    assert {r["symbol"] for r in lake.read("bronze").collect()} == {"MSFT"}
    lake.append_bronze(batch(spark, rows, "2024-06-01").limit(0), 1, writer="other")
    assert lake.read("bronze").count() == 0 and lake.read("bronze_log").count() == 0
    assert lake.append_bronze(batch(spark, rows, "2024-06-01"), 2)["written"] == 4


def test_emptied_partition_leaves_silver(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = make_bars(30)
    lake.append_bronze(batch(spark, rows, "2024-06-01"), 1)
    jobs.refresh_silver(lake, "a")
    months = lake.read("silver").select("month").distinct().count()
    bad = rows[rows["timestamp"].dt.month == 1].assign(high=-1.0)
    lake.append_bronze(batch(spark, bad, "2024-06-02"), 2)
    jobs.refresh_silver(lake, "b")
    assert lake.read("silver").select("month").distinct().count() == months - 1
