"""News cleaning, sentiment scoring and aggregates for all symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.text import BASIC, ENHANCED, Lexicon, add_sentiment, basic_sentiment, keyword_counts, space_tokens, strip
from barlake.operators.select import lookback, top_k
from barlake.plans.series import series


def clean_news(articles: DataFrame) -> DataFrame:
    """Defaults, trimmed text, derived columns and the `date` partition."""
    out = articles.withColumns(
        {
            "symbol": F.upper(F.coalesce("symbol", F.lit("MARKET"))),
            "title": strip("title"),
            "content": strip("content"),
            "url": F.coalesce("url", F.lit("")),
            "published_date": F.col("published_date").cast("timestamp"),
        }
    )
    if "ingestion_time" not in out.columns:
        out = out.withColumn("ingestion_time", F.current_timestamp())
    return out.withColumns(
        {
            "title_length": F.length("title"),
            "has_content": F.length("content") > 0,
            "date": F.to_date("published_date"),
        }
    )


def market_news(news: DataFrame, as_of: str | Column, days: int = 7) -> DataFrame:
    """Articles without a symbol of their own, newest first."""
    rows = news.filter(F.col("symbol") == "MARKET")
    return lookback(rows, as_of, "published_date", days=days).orderBy(F.desc("published_date"))


def symbol_news(news: DataFrame, as_of: str | Column, symbol: str, days: int = 30) -> DataFrame:
    rows = news.filter(F.col("symbol") == symbol.upper())
    return lookback(rows, as_of, "published_date", days=days).orderBy(F.desc("published_date"))


def names_symbol(title: str = "title", symbol: str = "symbol") -> Column:
    """The title mentions the symbol."""
    return F.contains(F.upper(title), F.upper(symbol))


def score_articles(articles: DataFrame, lexicon: Lexicon = ENHANCED, title_only: bool = False) -> DataFrame:
    """Sentiment columns from title and content (market news: title only)."""
    text = F.col("title") if title_only else F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return add_sentiment(articles, text, lexicon)


def basic_score(articles: DataFrame, lexicon: Lexicon = BASIC, text: str = "title") -> DataFrame:
    return articles.withColumn("sentiment", basic_sentiment(text, lexicon))


def keywords(articles: DataFrame, key: str, text: str | Column, k: int | None = 5) -> DataFrame:
    """The k most frequent words of every text, or all of them with their ranks; ties by first use."""
    counts = keyword_counts(articles, key, text)
    return top_k(counts, k, [key], [F.desc("uses"), F.asc("first")])


def with_keywords(articles: DataFrame, key: str, text: str | Column, k: int = 5) -> DataFrame:
    """Add `sentiment_keywords`, the comma-joined keywords; each list has at most k entries."""
    top = keywords(articles, key, text, k).groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",").alias(
            "sentiment_keywords"
        )
    )
    return articles.join(top, key, "left").withColumn("sentiment_keywords", F.coalesce("sentiment_keywords", F.lit("")))


def lexicon_matches(articles: DataFrame, key: str, text: str, lexicon: Lexicon = BASIC) -> DataFrame:
    """Lexicon words per text by an equi-join of exploded words with the word table.

    The word table is a literal of a few dozen rows.
    """
    spark = articles.sparkSession
    entries = [(w, "positive") for w in sorted(lexicon.positive)] + [(w, "negative") for w in sorted(lexicon.negative)]
    table = spark.createDataFrame(entries, "word string, class string")
    words = articles.select(key, F.explode(space_tokens(text)).alias("word"))
    return (
        words.join(F.broadcast(table), "word")
        .groupBy(key)
        .agg(F.count_if(F.col("class") == "positive").alias("positive"), F.count_if(F.col("class") == "negative").alias("negative"))
    )


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """Per (symbol, UTC date): mean, deviation and range of sentiment, confidence, article count."""
    s = F.col("sentiment")
    day = F.to_date("published_date").cast("timestamp").alias("date")
    out = scored.groupBy("symbol", day).agg(
        F.avg(s).alias("sentiment_mean"),
        F.stddev_samp(s).alias("sentiment_std"),
        F.min(s).alias("sentiment_min"),
        F.max(s).alias("sentiment_max"),
        F.avg("sentiment_confidence").alias("sentiment_confidence_mean"),
        F.count("title").alias("article_count"),
    )
    return out.withColumns(
        {
            "sentiment_positive": (F.col("sentiment_mean") > 0.2).cast("int"),
            "sentiment_negative": (F.col("sentiment_mean") < -0.2).cast("int"),
            "sentiment_range": F.col("sentiment_max") - F.col("sentiment_min"),
            "timestamp": F.col("date"),
            "source": F.lit("sentiment_agg"),
        }
    )


def sentiment_features(scored: DataFrame, windows: tuple[int, ...] = (3, 7, 14), **cut) -> DataFrame:
    """Daily sentiment with rolling means and counts over rows, defined from the first row on."""
    daily = scored.groupBy("symbol", F.to_date("published_date").cast("timestamp").alias("timestamp")).agg(
        F.avg("sentiment").alias("sentiment_mean"),
        F.stddev_samp("sentiment").alias("sentiment_std"),
        F.count("sentiment").alias("article_count"),
        F.avg("sentiment_confidence").alias("sentiment_confidence"),
        F.count_if(F.col("sentiment_label") == "positive").alias("positive_count"),
    )
    b = series(daily, before=max(windows), **cut)
    rolled = {}
    for n in windows:
        rolled[f"sentiment_ma_{n}"] = b.rolling(F.avg, "sentiment_mean", n, min_periods=1)
        rolled[f"sentiment_count_ma_{n}"] = b.rolling(F.sum, "article_count", n, min_periods=1)
    return b.add(rolled).rows().withColumnRenamed("timestamp", "date")


def _trend(mean: Column) -> Column:
    return F.when(mean > 0.2, "positive").when(mean < -0.2, "negative").otherwise("neutral")


def sentiment_summary(
    scored: DataFrame, as_of: str | Column, days: int = 7, threshold: float = 0.2, expected: DataFrame | None = None
) -> DataFrame:
    """Totals, means, signed counts and trend per symbol; `expected` symbols without articles get zeros."""
    rows = lookback(scored, as_of, "published_date", days=days)
    confidence = [F.avg("sentiment_confidence").alias("avg_confidence")] if "sentiment_confidence" in scored.columns else []
    out = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.avg("sentiment").alias("avg_sentiment"),
        *confidence,
        F.count_if(F.col("sentiment") > threshold).alias("positive_count"),
        F.count_if(F.col("sentiment") < -threshold).alias("negative_count"),
    )
    if expected is not None:
        out = expected.select("symbol").distinct().join(out, "symbol", "left").fillna(0).fillna(0.0)
    return out.withColumns(
        {
            "neutral_count": F.col("total_articles") - F.col("positive_count") - F.col("negative_count"),
            "trend": _trend(F.col("avg_sentiment")),
            "period_days": F.lit(days),
        }
    )


def summary_keywords(
    articles: DataFrame, key: str, text: str | Column, as_of: str | Column, days: int = 7, k: int = 10, per_article: int | None = 5
) -> DataFrame:
    """The k keywords most often among the `per_article` top ones of a symbol's articles (None: all), ties by first appearance."""
    rows = lookback(articles, as_of, "published_date", days=days)
    top = keywords(rows.select("symbol", key, F.struct("published_date", key).alias("_at"), text.alias("_text")).withColumn(
        "_key", F.struct("symbol", "_at")), "_key", "_text", per_article)
    counted = top.groupBy(F.col("_key.symbol").alias("symbol"), "word").agg(
        F.count(F.lit(1)).alias("articles"), F.min(F.struct(F.col("_key._at"), F.col("rank"))).alias("_first")
    )
    return top_k(counted, k, ["symbol"], [F.desc("articles"), F.asc("_first")])


def sentiment_timeseries(scored: DataFrame, as_of: str | Column, days: int = 30) -> DataFrame:
    """Per (symbol, date): mean sentiment and confidence, article count, and the symbol's trend."""
    rows = lookback(scored, as_of, "published_date", days=days)
    daily = rows.groupBy("symbol", F.to_date("published_date").cast("timestamp").alias("date")).agg(
        F.avg("sentiment").alias("sentiment"),
        F.avg("sentiment_confidence").alias("sentiment_confidence"),
        F.count("title").alias("article_count"),
    )
    overall = daily.groupBy("symbol").agg(_trend(F.avg("sentiment")).alias("trend"))
    return daily.join(overall, "symbol")


def article_totals(scored: DataFrame) -> DataFrame:
    """Article count, mean sentiment and signed counts per symbol."""
    return scored.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("sentiment").alias("avg_sentiment"),
        F.count_if(F.col("sentiment") > 0.2).alias("positive_count"),
        F.count_if(F.col("sentiment") < -0.2).alias("negative_count"),
    )
