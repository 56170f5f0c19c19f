"""Jobs over a lake: ingest, clean, gate, features, training. One run covers all symbols."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.text import ENHANCED, Lexicon
from barlake.operators import forecast as fc
from barlake.operators.backtest import backtest, metrics
from barlake.operators.market import index_features, index_summary, macro_features
from barlake.operators.news import clean_news, daily_sentiment, score_articles, sentiment_summary
from barlake.operators.quality import passed_only, quality_report, quarantine, silver, silver_quality
from barlake.operators.select import latest, latest_per_model, of_symbol
from barlake.plans.dashboard import overview
from barlake.plans.gold import gold
from barlake.sources.payloads import fundamentals, macro_long
from barlake.sources.tables import PARTITION, Lake, layer_counts


def ingest(lake: Lake, bars: DataFrame, batch_seq: int, lineage: dict[str, str] | None = None, writer: str = "batch") -> dict[str, int]:
    """Source bars of any number of symbols to Bronze; returns the counts of the batch."""
    return lake.append_bronze(bars, batch_seq, lineage, writer)


def ingest_macro(lake: Lake, families: Mapping[str, tuple[DataFrame, str, str]], run_id: str) -> None:
    """Exchange rates, gold, oil, rates and price index to one long table."""
    lake.log("macro", macro_long(dict(families)), run_id)


def ingest_news(lake: Lake, articles: DataFrame, run_id: str, lexicon: Lexicon = ENHANCED) -> None:
    """Cleaned and scored articles by publication date, and their daily sentiment aggregates."""
    lake.log("silver_news", score_articles(clean_news(articles), lexicon), run_id, ("date",))
    scored = lake.read_log("silver_news").filter(F.col("run_id") == run_id)
    lake.log("gold_sentiment", daily_sentiment(scored).drop("timestamp"), run_id)


def ingest_sentiment(lake: Lake, as_of: str, run_id: str, days: int = 7) -> None:
    """One sentiment summary row per symbol from the stored articles."""
    lake.log("sentiment_summary", sentiment_summary(lake.read_log("silver_news"), as_of, days), run_id)


def ingest_fundamentals(lake: Lake, records: DataFrame, run_id: str) -> None:
    lake.log("silver_fundamentals", fundamentals(records), run_id, ("symbol",))


def latest_fundamentals(lake: Lake) -> DataFrame:
    return latest(lake.read_log("silver_fundamentals"))


def write_index_features(lake: Lake, bars: DataFrame, run_id: str) -> None:
    lake.log("gold_index", index_features(index_summary(bars)), run_id)


def write_macro_features(lake: Lake, summary: DataFrame, run_id: str) -> None:
    lake.log("gold_macro", macro_features(summary), run_id)


def refresh_silver(lake: Lake, run_id: str, touched: DataFrame | None = None) -> None:
    """Bronze to Silver, quarantine and quality log; `touched` limits it to some partitions."""
    rows = lake.read("bronze")
    if touched is not None:
        rows = rows.join(touched.select(*PARTITION).distinct(), list(PARTITION), "left_semi")
    rows = rows.drop("year", "month")
    clean = silver(rows)
    lake.write_layer("silver", clean)
    lake.clear_stale("silver", clean.select("symbol", "timestamp"), touched)
    lake.log("silver_errors", quarantine(rows), run_id)
    lake.log("quality", silver_quality(rows), run_id)


def run(lake: Lake, run_id: str, macro: DataFrame | None = None) -> DataFrame:
    """Silver, gate, Gold and run record for all symbols; returns the run record."""
    refresh_silver(lake, run_id)
    clean = lake.read("silver").drop("year", "month")
    report = quality_report(clean, expected=lake.read("bronze").select("symbol"))
    lake.log("gate", report, run_id)
    report = lake.read_log("gate").filter(F.col("run_id") == run_id)
    passed = passed_only(clean, report)
    lake.write_layer("gold", gold(passed, macro=macro, store=True).drop("batch_seq"))
    lake.clear_stale("gold", passed.select("symbol", "timestamp"))
    record = report.select(
        "symbol",
        F.when(F.col("quality_status") == "passed", "completed").otherwise("failed").alias("status"),
        F.col("row_count").alias("records_processed"),
        F.col("invalid_ohlc_count").alias("error_count"),
        F.when(F.col("quality_status") == "passed", "Gold written").otherwise("Critical data quality failure").alias("message"),
    )
    lake.log("pipeline_runs", record, run_id)
    return lake.read_log("pipeline_runs").filter(F.col("run_id") == run_id)


def train(lake: Lake, run_id: str, model: str = "linear_regression") -> DataFrame:
    """Fit and evaluate a model for all symbols; stores coefficients, predictions and one run per symbol."""
    bars = lake.read("gold").drop("year", "month")
    if model == "linear_regression":
        out = fc.train_linear(bars)
        lake.log("model_stats", out["stats"], run_id)
    elif model == "arima":
        out = fc.train_ar(bars)
    else:
        raise ValueError(f"unsupported model: {model}")
    lake.log("model_coefficients", out["coefficients"].withColumn("model_name", F.lit(model)), run_id)
    lake.log("model_predictions", out["predictions"].withColumn("model_name", F.lit(model)), run_id)
    lake.log("model_runs", out["runs"], run_id)
    return lake.read_log("model_runs").filter(F.col("run_id") == run_id)


def trained_models(lake: Lake, symbol: str | None = None) -> DataFrame:
    """Latest run of each model and symbol, with its metrics and periods."""
    runs = lake.read_log("model_runs")
    return latest_per_model(runs if symbol is None else of_symbol(runs, symbol))


def predict(lake: Lake, run_id: str, model: str = "linear_regression", last: int = 120, horizon: int = 5) -> DataFrame:
    """Predictions of all symbols from the coefficients stored by a training run."""
    bars = lake.read("gold").drop("year", "month")
    stored = lambda name: lake.read_log(name).filter(F.col("run_id") == run_id).drop("run_id", "created_at")
    coefficients = stored("model_coefficients")
    if model == "linear_regression":
        return fc.predict_linear(bars, stored("model_stats"), coefficients, last)
    return fc.predict_ar(bars, coefficients, horizon)


def run_backtest(lake: Lake, run_id: str, strategy: str, params: Mapping | None = None, **costs) -> DataFrame:
    """Backtest of all symbols on Gold bars, logged with one record per symbol."""
    bars = lake.read("gold").drop("year", "month")
    out = metrics(backtest(bars, strategy, params, **costs), costs.get("initial_capital", 10_000.0))
    lake.log("backtest_runs", out.withColumn("strategy", F.lit(strategy)), run_id)
    return lake.read_log("backtest_runs").filter(F.col("run_id") == run_id)


def dashboard(lake: Lake) -> DataFrame:
    """Overview of every symbol from the stored layers and logs."""
    layers = {name: lake.read(name) for name in ("bronze", "silver", "gold")}
    logs = {"model": "model_runs", "backtest": "backtest_runs", "pipeline": "pipeline_runs"}
    runs = {name: lake.read_log(table) for name, table in logs.items() if lake.exists(table)}
    return overview(layers["gold"], layer_counts(layers), runs)


