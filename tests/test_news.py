"""Sentiment, keywords and news aggregates against small plain-Python rules."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from barlake.functions import text as tx
from barlake.operators import news as nw
from tests.conftest import collect


def plain_score(text: str, lex: tx.Lexicon):
    low = text.lower()
    words = re.sub(r"[^\w\s]", " ", low).split()
    up2 = up = down2 = down = at = 0
    while at < len(words):
        p3, p2, w = " ".join(words[at : at + 3]), " ".join(words[at : at + 2]), words[at]
        if p3 in lex.strong_positive or p2 in lex.strong_positive:
            up2, at = up2 + 1, at + (3 if p3 in lex.strong_positive else 2)
        elif p3 in lex.strong_negative or p2 in lex.strong_negative:
            down2, at = down2 + 1, at + (3 if p3 in lex.strong_negative else 2)
        else:
            up += w in lex.strong_positive or w in lex.positive
            down += w not in lex.strong_positive | lex.positive and w in lex.strong_negative | lex.negative
            at += 1
    n = up2 + up + down2 + down
    s = (2 * up2 + up - 2 * down2 - down) / n if n else 0.0
    s *= -0.8 if any(x in low for x in lex.negators) else 1
    s *= next((v for k, v in lex.intensifiers.items() if k in low), 1)
    return max(-1, min(1, s)), min(1, n / 5), up2, down2, up + up2, down + down2


SENTENCES = [
    "", "Lợi nhuận tăng rất mạnh", "Công ty thua lỗ, rủi ro cao", "strong buy upgrade", "not a loss", "upgrade",
    "profit, growth & gain!", "Doanh thu tăng; lợi nhuận tăng.", "cổ tức cao", "A very bearish drop", "phá sản vì vi phạm",
    "tăng giá mạnh extremely bullish", "lãi", "no news", "investigation of fraud downgrade",
]


def sentences():
    rng = random.Random(5)
    vocabulary = sorted(tx.ENHANCED.strong_positive | tx.ENHANCED.positive | tx.ENHANCED.strong_negative | tx.ENHANCED.negative)
    fillers = ["the", "market", "hôm nay", "x1", "_", "rất", "không", "2,5%"]
    made = [" ".join(rng.choice(vocabulary if rng.random() < 0.6 else fillers) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    return SENTENCES + made


def test_enhanced_sentiment(spark):
    texts = sentences()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = collect(tx.add_sentiment(df, "text"), "id")
    columns = ["sentiment", "sentiment_confidence", "strong_positive", "strong_negative", "positive_signals", "negative_signals"]
    for got, text in zip(rows.itertuples(), texts):
        want = plain_score(text, tx.ENHANCED)
        assert [getattr(got, c) for c in columns] == pytest.approx(want), text
        label = "positive" if want[0] >= 0.3 else "negative" if want[0] <= -0.3 else "neutral"
        assert got.sentiment_label == label
    assert rows["strong_positive"].sum() > 20 and rows["strong_negative"].sum() > 20


def test_own_lexicon(spark):
    lex = tx.Lexicon(positive=frozenset(["moon"]), negative=frozenset(["rug"]), intensifiers={"to the": 2.0})
    df = spark.createDataFrame([("Moon rug moon to the",)], "text string")
    assert tx.add_sentiment(df, "text", lex).first()["sentiment"] == pytest.approx(2 / 3)


def test_basic_sentiment(spark):
    df = spark.createDataFrame([("Profit up, loss",), (None,), ("gain drop growth",)], "t string")
    assert [r[0] for r in df.select(tx.basic_sentiment("t")).collect()] == pytest.approx([0.0, 0.0, 1 / 3])


def test_tokens_and_symbols(spark):
    df = spark.createDataFrame([("Giá VNM: tăng 2,5% – x_1",), ("rsi of msft?",), ("RSI now",), ("Ünï ABCDEF go",)], "t string")
    assert df.select(tx.tokens("t")).first()[0] == ["giá", "vnm", "tăng", "2", "5", "x_1"]
    assert [r[0] for r in df.select(tx.extract_symbol("t")).collect()] == ["VNM", "MSFT", "AAPL", "GO"]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "beta alpha beta the the to gamma alpha beta"), (2, "a an")], "id int, text string")
    got = collect(nw.keywords(df, "id", "text", 2), "rank")
    assert got["word"].tolist() == ["beta", "alpha"] and got["uses"].tolist() == [3, 2]
    joined = {r["id"]: r["sentiment_keywords"] for r in nw.with_keywords(df, "id", "text", 5).collect()}
    assert joined == {1: "beta,alpha,gamma", 2: ""}


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    n = 300
    pdf = pd.DataFrame(
        {
            "symbol": rng.choice(["A", "B", "MARKET"], n),
            "title": [f"t{i}" for i in range(n)],
            "published_date": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40 * 24, n), "h"),
            "sentiment": rng.uniform(-1, 1, n),
            "sentiment_confidence": rng.uniform(0, 1, n),
        }
    )
    pdf["sentiment_label"] = np.where(pdf["sentiment"] >= 0.3, "positive", "neutral")
    return pdf, spark.createDataFrame(pdf)


def test_daily_and_rolling(scored):
    pdf, df = scored
    day = pdf.assign(date=pdf["published_date"].dt.floor("D")).groupby(["symbol", "date"])
    got = collect(nw.daily_sentiment(df), "symbol", "date")
    np.testing.assert_allclose(got["sentiment_std"], day["sentiment"].std())
    np.testing.assert_array_equal(got["article_count"], day["title"].count())
    for size in (3, None):
        rolled = collect(nw.sentiment_features(df, block_rows=size), "symbol", "date")
        mean = day["sentiment"].mean().groupby("symbol").transform(lambda x: x.rolling(7, min_periods=1).mean())
        np.testing.assert_allclose(rolled["sentiment_ma_7"], mean)
        count = day["sentiment"].count().groupby("symbol").transform(lambda x: x.rolling(14, min_periods=1).sum())
        np.testing.assert_allclose(rolled["sentiment_count_ma_14"], count)


def test_summary(scored, spark):
    pdf, df = scored
    expected = spark.createDataFrame([("A",), ("NONE",)], "symbol string")
    got = {r["symbol"]: r for r in nw.sentiment_summary(df, "2024-02-10", 10, expected=expected).collect()}
    rows = pdf[(pdf["symbol"] == "A") & (pdf["published_date"] >= "2024-01-31")]
    assert got["A"]["total_articles"] == len(rows)
    assert got["A"]["positive_count"] == (rows["sentiment"] > 0.2).sum()
    assert got["NONE"]["total_articles"] == 0 and got["NONE"]["trend"] == "neutral"


def test_cleaning(spark):
    df = spark.createDataFrame([(None, "  Hi\n", None, None, "2024-01-02 03:00:00")], "symbol string, title string, content string, url string, published_date string")
    row = nw.clean_news(df).first()
    assert (row["symbol"], row["title"], row["content"], row["url"], row["has_content"]) == ("MARKET", "Hi", "", "", False)
    assert str(row["date"]) == "2024-01-02"
