"""Tokens, lexicon sentiment, keywords and symbols as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
NON_SPACE = r"[^\s\p{Z}]+"


@dataclass(frozen=True)
class Lexicon:
    strong_positive: frozenset[str] = frozenset()
    positive: frozenset[str] = frozenset()
    strong_negative: frozenset[str] = frozenset()
    negative: frozenset[str] = frozenset()
    intensifiers: dict[str, float] = field(default_factory=dict)
    negators: tuple[str, ...] = ()


# Default word lists (Vietnamese and English market vocabulary).
ENHANCED = Lexicon(
    strong_positive=frozenset(
        [
            "tăng trưởng", "lợi nhuận", "lãi", "tích cực", "khởi sắc", "bứt phá",
            "lạc quan", "hưởng lợi", "vượt kỳ vọng", "kỷ lục", "thắng lớn",
            "lợi nhuận tăng", "doanh thu tăng", "cổ tức cao", "tăng giá mạnh",
            "breakout", "outperform", "buy rating", "upgrade", "strong buy",
        ]
    ),
    positive=frozenset(
        [
            "tăng", "cổ tức", "vượt", "lên", "cải thiện", "mở rộng",
            "đầu tư", "hợp tác", "ký kết", "triển vọng", "khả quan",
            "tốt", "đà", "hồi phục", "ổn định", "tích cực",
            "rise", "profit", "growth", "positive", "bullish", "gain", "up",
        ]
    ),
    strong_negative=frozenset(
        [
            "thua lỗ", "lỗ lớn", "lao dốc", "phá sản", "bị điều tra",
            "bị kiểm tra", "vi phạm", "xử phạt", "cảnh báo", "rủi ro cao",
            "mất khả năng", "giải thể", "phá đổ", "thua kiện",
            "bankruptcy", "fraud", "investigation", "downgrade", "strong sell",
        ]
    ),
    negative=frozenset(
        [
            "giảm", "lỗ", "tiêu cực", "trì trệ", "sụt giảm",
            "rủi ro", "bất lợi", "xuống", "giáng", "yếu",
            "khó khăn", "thận trọng", "giảm giá", "bán ra",
            "fall", "loss", "decline", "negative", "bearish", "drop",
        ]
    ),
    intensifiers={
        "rất": 1.5, "cực kỳ": 2.0, "quá": 1.3, "vô cùng": 1.8,
        "highly": 1.5, "extremely": 2.0, "very": 1.3,
    },
    negators=("không", "chưa", "chẳng", " không", "không có", "not", "no", "never", "neither"),
)

# Word lists of the basic score.
BASIC = Lexicon(
    positive=frozenset(
        [
            "tăng", "lợi nhuận", "lãi", "tích cực", "khởi sắc", "bứt phá",
            "tăng trưởng", "lạc quan", "hưởng lợi", "cổ tức", "vượt", "lên",
            "rise", "profit", "growth", "positive", "bullish", "gain", "up",
        ]
    ),
    negative=frozenset(
        [
            "giảm", "thua lỗ", "lỗ", "tiêu cực", "trì trệ", "sụt giảm",
            "rủi ro", "bất lợi", "lao dốc", "xuống", "phá", "giáng",
            "fall", "loss", "decline", "negative", "bearish", "drop", "down",
        ]
    ),
)

# Words that are no keywords.
STOPWORDS = [
    "và", "của", "là", "có", "được", "trong", "cho", "với",
    "theo", "tại", "đã", "sẽ", "để", "từ", "này", "các",
    "and", "the", "is", "are", "was", "were", "be", "to", "of",
]

# Symbols known by name, and indicator names that are no symbols.
KNOWN_SYMBOLS = ["AAPL", "MSFT", "GOOGL", "TSLA", "NVDA", "AMZN", "META"]
INDICATOR_NAMES = ["RSI", "MACD", "SMA", "EMA", "LSTM", "MA"]


def _text(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def tokens(text: str | Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(WORD), F.lit(0))


def space_tokens(text: str | Column) -> Column:
    """Lower-case runs of non-space characters."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(NON_SPACE), F.lit(0))


def ngrams(words: str | Column, n: int) -> Column:
    """n consecutive words at every position, shorter at the end."""
    words = F.col(words) if isinstance(words, str) else words
    at = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(n))))


def basic_sentiment(text: str | Column, lexicon: Lexicon = BASIC) -> Column:
    """(positive - negative) / (positive + negative) over space-separated words."""
    words = space_tokens(text)
    hits = lambda entries: F.size(F.filter(words, lambda w: w.isin(sorted(entries))))
    up, down = hits(lexicon.positive), hits(lexicon.negative)
    return F.coalesce(F.try_divide((up - down).cast("double"), up + down), F.lit(0.0))


def label(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 0.3, "positive").when(score <= -0.3, "negative").otherwise("neutral")


def _isin(c: Column, entries) -> Column:
    return c.isin(sorted(entries)) if entries else F.lit(False)


def sentiment_hits(words: str, lexicon: Lexicon) -> Column:
    """Positions whose word or phrase is in the lexicon, with what was found and its length.

    Kinds: 1 strong positive, 2 strong negative, 3 positive, 4 negative. A phrase check reads up to
    three words and is cut at the end of the text.
    """
    w = F.col(words)
    entries = lexicon.strong_positive | lexicon.positive | lexicon.strong_negative | lexicon.negative
    # Phrases are built only where a word starts an entry.
    starts = {e.split()[0] for e in entries}

    def at(word: Column, i: Column) -> Column:
        three = F.concat_ws(" ", F.slice(w, i + 1, F.lit(3)))
        two = F.concat_ws(" ", F.slice(w, i + 1, F.lit(2)))
        found = lambda kind, length: F.struct(
            i.alias("at"), F.lit(kind).alias("kind"), F.lit(length).alias("length")
        )
        strong = (
            F.when(_isin(three, lexicon.strong_positive), found(1, 3))
            .when(_isin(two, lexicon.strong_positive), found(1, 2))
            .when(_isin(three, lexicon.strong_negative), found(2, 3))
            .when(_isin(two, lexicon.strong_negative), found(2, 2))
        )
        found_any = strong.when(_isin(word, lexicon.strong_positive | lexicon.positive), found(3, 1)).when(
            _isin(word, lexicon.strong_negative | lexicon.negative), found(4, 1)
        )
        return F.when(_isin(word, starts), found_any)

    return F.array_compact(F.transform(w, at))


def add_sentiment(df: DataFrame, text: str | Column, lexicon: Lexicon = ENHANCED) -> DataFrame:
    """Add sentiment, sentiment_confidence, sentiment_label and the signal counts of a text column.

    Words are scanned left to right; a matched phrase consumes its words. Only positions with a
    lexicon hit take part in the scan. Negators and intensifiers are looked up anywhere in the text.
    """
    df = df.withColumn("_lower", F.lower(_text(text)))
    df = df.withColumn("_words", F.regexp_extract_all("_lower", F.lit(WORD), F.lit(0)))
    df = df.withColumn("_hits", sentiment_hits("_words", lexicon))
    zero = F.struct(
        F.lit(0).alias("free"), F.lit(0).alias("sp"), F.lit(0).alias("sn"), F.lit(0).alias("p"), F.lit(0).alias("n")
    )

    def step(acc: Column, hit: Column) -> Column:
        more = lambda name, kind: (acc[name] + F.when(hit["kind"] == kind, 1).otherwise(0)).alias(name)
        taken = F.struct(
            (hit["at"] + hit["length"]).alias("free"), more("sp", 1), more("sn", 2), more("p", 3), more("n", 4)
        )
        return F.when(hit["at"] >= acc["free"], taken).otherwise(acc)

    df = df.withColumn("_s", F.aggregate("_hits", zero, step))
    sp, sn, p, n = (F.col(f"_s.{c}") for c in ("sp", "sn", "p", "n"))
    total = sp + sn + p + n
    score = F.coalesce(F.try_divide((2 * sp + p - 2 * sn - n).cast("double"), total), F.lit(0.0))
    negated = F.lit(False)
    for entry in lexicon.negators:
        negated = negated | F.contains(F.col("_lower"), F.lit(entry))
    factor = F.when(negated, -0.8).otherwise(1.0)
    boost = F.lit(1.0)
    for entry, value in reversed(list(lexicon.intensifiers.items())):
        boost = F.when(F.contains(F.col("_lower"), F.lit(entry)), F.lit(value)).otherwise(boost)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score * (factor * boost))) + 0.0
    df = df.withColumns(
        {
            "sentiment": clamped,
            "sentiment_confidence": F.least(F.lit(1.0), total / F.lit(5.0)),
            "positive_signals": p + sp,
            "negative_signals": n + sn,
            "strong_positive": sp,
            "strong_negative": sn,
        }
    )
    return df.withColumn("sentiment_label", label("sentiment")).drop("_lower", "_words", "_hits", "_s")


def keyword_counts(df: DataFrame, key: str, text: str | Column) -> DataFrame:
    """(key, word, uses, first position) of every keyword; counts combine before the shuffle."""
    words = df.select(key, F.posexplode(tokens(text)).alias("pos", "word"))
    words = words.filter((F.length("word") > 2) & ~F.col("word").isin(STOPWORDS))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("uses"), F.min("pos").alias("first"))


def extract_symbol(text: str | Column, default: str = "AAPL") -> Column:
    """A known symbol in the text, else its first word of 1-5 letters unless that names an indicator."""
    upper = F.upper(_text(text))
    edge_l, edge_r = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    known = [F.when(upper.rlike(f"{edge_l}{s}{edge_r}"), s) for s in KNOWN_SYMBOLS]
    word = F.regexp_extract(upper, f"{edge_l}([A-Z]{{1,5}}){edge_r}", 1)
    other = F.when((word != "") & ~word.isin(INDICATOR_NAMES), word)
    return F.coalesce(*known, other, F.lit(default.upper()))


def strip(text: str | Column) -> Column:
    """Text without leading and trailing white space; null becomes empty."""
    return F.regexp_replace(_text(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
