"""Text functions, sentiment and news aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.catalog.base import query
from barlake.functions import text as tx
from barlake.operators import news as nw
from barlake.operators.select import top_k
from barlake.plans.views import NEEDS, SQL

# Frequent words of the test documents, so that every branch of the score is reached.
LEXICON = tx.Lexicon(
    strong_positive=frozenset(["of the", "that it"]),
    positive=frozenset(["the", "la"]),
    strong_negative=frozenset(["to be", "in der"]),
    negative=frozenset(["der", "is"]),
    intensifiers={"with": 1.5, "und": 1.2},
    negators=("no",),
)
_BASIC = tx.Lexicon(positive=LEXICON.positive, negative=LEXICON.negative)
AS_OF = "2024-01-31"
#: Articles without a symbol fall on the 1st, 11th and 21st.
MARKET_AS_OF = "2024-01-25"

_W = r"'[\p{L}\p{N}_]+'"
_S = r"'[^\s\p{Z}]+'"
SQL["full"] = """SELECT doc_id, symbol, title, content, published_date, source, url,
    lower(title || ' ' || content) AS low FROM news"""
SQL["wordpos"] = f"""SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i
    FROM (SELECT doc_id, regexp_extract_all(low, {_W}) AS ws FROM full_)"""
SQL["full_"] = SQL.pop("full")
SQL["hits0"] = """SELECT doc_id, i, w, concat_ws(' ', w, a) AS two, concat_ws(' ', w, a, b) AS three
    FROM (SELECT *, lead(w) OVER o AS a, lead(w, 2) OVER o AS b FROM wordpos WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""
SQL["hits"] = """SELECT doc_id, i, kind, len, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, i, CASE WHEN three IN ('of the', 'that it') OR two IN ('of the', 'that it') THEN 1
    WHEN three IN ('to be', 'in der') OR two IN ('to be', 'in der') THEN 2
    WHEN w IN ('of the', 'that it', 'the', 'la') THEN 3 WHEN w IN ('to be', 'in der', 'der', 'is') THEN 4 END AS kind,
    CASE WHEN three IN ('of the', 'that it') THEN 3 WHEN two IN ('of the', 'that it') THEN 2
    WHEN three IN ('to be', 'in der') THEN 3 WHEN two IN ('to be', 'in der') THEN 2 ELSE 1 END AS len
    FROM hits0) WHERE kind IS NOT NULL"""
SQL["walk"] = """SELECT doc_id, k, i + len AS free, kind AS took FROM hits WHERE k = 1
    UNION ALL SELECT h.doc_id, h.k, CASE WHEN h.i >= s.free THEN h.i + h.len ELSE s.free END,
    CASE WHEN h.i >= s.free THEN h.kind ELSE 0 END FROM walk s JOIN hits h ON h.doc_id = s.doc_id AND h.k = s.k + 1"""
SQL["signals"] = """SELECT doc_id, count(*) FILTER (took = 1) AS sp, count(*) FILTER (took = 2) AS sn,
    count(*) FILTER (took = 3) AS p, count(*) FILTER (took = 4) AS n FROM walk GROUP BY ALL"""
SQL["scored"] = """SELECT *, CASE WHEN sentiment >= 0.3 THEN 'positive' WHEN sentiment <= -0.3 THEN 'negative'
    ELSE 'neutral' END AS sentiment_label FROM (
    SELECT f.*, sp, sn, p, n, coalesce(p + sp, 0) AS positive_signals, coalesce(n + sn, 0) AS negative_signals,
    coalesce(sp, 0) AS strong_positive, coalesce(sn, 0) AS strong_negative,
    greatest(-1.0, least(1.0, coalesce((2 * sp + p - 2 * sn - n) / CAST(sp + sn + p + n AS DOUBLE), 0)
      * (CASE WHEN contains(low, 'no') THEN -0.8 ELSE 1.0 END
      * CASE WHEN contains(low, 'with') THEN 1.5 WHEN contains(low, 'und') THEN 1.2 ELSE 1.0 END))) AS sentiment,
    least(1.0, coalesce(sp + sn + p + n, 0) / CAST(5 AS DOUBLE)) AS sentiment_confidence
    FROM full_ f LEFT JOIN signals USING (doc_id))"""
NEEDS["full_"] = ["news"]
NEEDS["wordpos"] = ["news", "full_"]
NEEDS["hits0"] = NEEDS["wordpos"] + ["wordpos"]
NEEDS["hits"] = NEEDS["hits0"] + ["hits0"]
NEEDS["walk"] = NEEDS["hits"] + ["hits"]
NEEDS["signals"] = NEEDS["walk"] + ["walk"]
NEEDS["scored"] = NEEDS["signals"] + ["signals"]


def _scored(t):
    return nw.score_articles(t.news, LEXICON)


def _combined():
    return F.concat_ws(" ", F.col("title"), F.col("content"))


query(
    "f_sent",
    "doc_id:i sentiment:6 sentiment_confidence:6 positive_signals:i negative_signals:i strong_positive:i "
    "strong_negative:i sentiment_label",
    "SELECT * FROM scored",
    "scored",
)(_scored)

query(
    "f_str",
    "doc_id:i up low trimmed n:i has_the joined head",
    r"""SELECT doc_id, upper(source) AS up, lower(source) AS low,
       regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS trimmed, length(text) AS n,
       contains(lower(text), 'the') AS has_the, lang || '-' || source AS joined, substring(text, 1, 2000) AS head
       FROM documents""",
)(
    lambda t: t.table("documents").select(
        "doc_id",
        F.upper("source").alias("up"),
        F.lower("source").alias("low"),
        tx.strip("text").alias("trimmed"),
        F.length("text").alias("n"),
        F.contains(F.lower("text"), F.lit("the")).alias("has_the"),
        F.concat_ws("-", "lang", "source").alias("joined"),
        F.substring("text", 1, 2000).alias("head"),
    )
)

_CLEAN = r"""SELECT doc_id, upper(coalesce(symbol, 'MARKET')) AS symbol,
    regexp_replace(title, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS title,
    regexp_replace(content, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS content, coalesce(url, '') AS url,
    published_date, source FROM news"""
query(
    "f_hascontent",
    "doc_id:i title_length:i has_content",
    f"SELECT doc_id, length(title) AS title_length, length(content) > 0 AS has_content FROM ({_CLEAN})",
    "news",
)(lambda t: nw.clean_news(t.news))
query("p_fill", "doc_id:i symbol title url", f"SELECT * FROM ({_CLEAN})", "news")(lambda t: nw.clean_news(t.news))
query(
    "o_news_wr",
    "doc_id:i symbol title content url published_date:t source title_length:i has_content date",
    f"""SELECT *, length(title) AS title_length, length(content) > 0 AS has_content, CAST(published_date AS DATE) AS date
        FROM ({_CLEAN})""",
    "news",
)(lambda t: nw.clean_news(t.news))
query(
    "p_market",
    "doc_id:i symbol published_date:t",
    f"SELECT * FROM ({_CLEAN}) WHERE symbol = 'MARKET' AND published_date >= TIMESTAMP '{MARKET_AS_OF}' - INTERVAL 7 DAY",
    "news",
)(lambda t: nw.market_news(nw.clean_news(t.news), MARKET_AS_OF))
query(
    "p_newsrel",
    "doc_id:i lang",
    "SELECT doc_id, lang FROM documents WHERE contains(upper(text), upper(lang))",
)(lambda t: t.table("documents").filter(nw.names_symbol("text", "lang")))
query(
    "f_tok",
    "doc_id:i n:i first last joined",
    f"""SELECT doc_id, len(ws) AS n, ws[1] AS first, ws[-1] AS last, array_to_string(ws, ' ') AS joined
        FROM (SELECT doc_id, regexp_extract_all(lower(text), {_W}) AS ws FROM documents)""",
)(
    lambda t: t.table("documents")
    .select("doc_id", tx.tokens("text").alias("ws"))
    .select(
        "doc_id",
        F.size("ws").alias("n"),
        F.try_element_at("ws", F.lit(1)).alias("first"),
        F.try_element_at("ws", F.lit(-1)).alias("last"),
        F.array_join("ws", " ").alias("joined"),
    )
)
query(
    "f_arr",
    "doc_id:i head first bigrams:i last_bigram",
    f"""SELECT doc_id, array_to_string(ws[1:3], ' ') AS head, ws[1] AS first, len(ws) AS bigrams, ws[-1] AS last_bigram
        FROM (SELECT doc_id, regexp_extract_all(lower(text), {_W}) AS ws FROM documents)""",
)(
    lambda t: t.table("documents")
    .select("doc_id", tx.tokens("text").alias("ws"))
    .select(
        "doc_id",
        F.array_join(F.slice("ws", 1, 3), " ").alias("head"),
        F.try_element_at("ws", F.lit(1)).alias("first"),
        F.size(tx.ngrams("ws", 2)).alias("bigrams"),
        F.try_element_at(tx.ngrams("ws", 2), F.lit(-1)).alias("last_bigram"),
    )
)
_POSNEG = f"""SELECT doc_id, len(list_filter(ws, lambda w: w IN ('the', 'la'))) AS up,
    len(list_filter(ws, lambda w: w IN ('der', 'is'))) AS down
    FROM (SELECT doc_id, regexp_extract_all(lower(text), {_S}) AS ws FROM documents)"""
query(
    "f_sent0",
    "doc_id:i sentiment:6",
    f"SELECT doc_id, CASE WHEN up + down > 0 THEN (up - down) / CAST(up + down AS DOUBLE) ELSE 0 END AS sentiment FROM ({_POSNEG})",
)(lambda t: t.table("documents").select("doc_id", tx.basic_sentiment("text", _BASIC).alias("sentiment")))
query(
    "j_lex",
    "doc_id:i positive:i negative:i",
    f"SELECT doc_id, up AS positive, down AS negative FROM ({_POSNEG}) WHERE up + down > 0",
)(lambda t: nw.lexicon_matches(t.table("documents"), "doc_id", "text", _BASIC))
query(
    "f_label",
    "doc_id:i sentiment_label",
    f"""SELECT doc_id, CASE WHEN s >= 0.3 THEN 'positive' WHEN s <= -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label
        FROM (SELECT doc_id, CASE WHEN up + down > 0 THEN (up - down) / CAST(up + down AS DOUBLE) ELSE 0 END AS s FROM ({_POSNEG}))""",
)(lambda t: t.table("documents").select("doc_id", tx.label(tx.basic_sentiment("text", _BASIC)).alias("sentiment_label")))
_KNOWN = " ".join(
    f"WHEN regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}_]){s}($|[^\\p{{L}}\\p{{N}}_])') THEN '{s}'" for s in tx.KNOWN_SYMBOLS
)
query(
    "f_symx",
    "doc_id:i symbol",
    f"""SELECT doc_id, CASE {_KNOWN} WHEN x <> '' AND x NOT IN ('RSI', 'MACD', 'SMA', 'EMA', 'LSTM', 'MA') THEN x
        ELSE 'AAPL' END AS symbol FROM (SELECT doc_id, u,
        regexp_extract(u, '(^|[^\\p{{L}}\\p{{N}}_])([A-Z]{{1,5}})($|[^\\p{{L}}\\p{{N}}_])', 2) AS x
        FROM (SELECT doc_id, replace(replace(upper(text), 'ß', 'SS'), 'ẞ', 'SS') AS u FROM documents))""",
)(lambda t: t.table("documents").select("doc_id", tx.extract_symbol("text").alias("symbol")))

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
SQL["kw"] = f"""SELECT doc_id, w AS word, count(*) AS uses, min(i) AS first FROM wordpos
    WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY ALL"""
SQL["kwtop"] = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, first) AS rank FROM kw QUALIFY rank <= 5"
NEEDS["kw"] = NEEDS["wordpos"] + ["wordpos"]
NEEDS["kwtop"] = NEEDS["kw"] + ["kw"]
query("a_topk", "doc_id:i word uses:i rank:i", "SELECT * FROM kwtop", "kwtop")(
    lambda t: nw.keywords(t.news, "doc_id", _combined())
)
query(
    "l_topk",
    "symbol word uses:i rank:i",
    """SELECT symbol, word, sum(uses) AS uses, row_number() OVER (PARTITION BY symbol ORDER BY sum(uses) DESC, word) AS rank
       FROM kw JOIN full_ USING (doc_id) WHERE symbol IS NOT NULL GROUP BY symbol, word QUALIFY rank <= 10""",
    "kw",
)(
    lambda t: top_k(
        tx.keyword_counts(t.news.filter("symbol IS NOT NULL"), "symbol", _combined()), 10, ["symbol"], [F.desc("uses"), F.asc("word")]
    )
)
query(
    "o_sentrow",
    "doc_id:i symbol sentiment:6 sentiment_confidence:6 sentiment_label sentiment_keywords source",
    """SELECT s.*, coalesce(ks, '') AS sentiment_keywords FROM scored s LEFT JOIN
       (SELECT doc_id, string_agg(word, ',' ORDER BY rank) AS ks FROM kwtop GROUP BY ALL) USING (doc_id)""",
    "scored kwtop",
)(lambda t: nw.with_keywords(_scored(t), "doc_id", _combined()))


def _by_symbol(t):
    return nw.clean_news(_scored(t))


SQL["sn"] = "SELECT * REPLACE (upper(coalesce(symbol, 'MARKET')) AS symbol) FROM scored"
NEEDS["sn"] = NEEDS["scored"] + ["scored"]
query(
    "a_sentd",
    "symbol date:t sentiment_mean:6 sentiment_std:6 sentiment_min:6 sentiment_max:6 sentiment_confidence_mean:6 "
    "article_count:i sentiment_positive:i sentiment_negative:i sentiment_range:6 timestamp:t source",
    """SELECT symbol, date_trunc('day', published_date) AS date, avg(sentiment) AS sentiment_mean,
       stddev_samp(sentiment) AS sentiment_std, min(sentiment) AS sentiment_min, max(sentiment) AS sentiment_max,
       avg(sentiment_confidence) AS sentiment_confidence_mean, count(title) AS article_count,
       CASE WHEN avg(sentiment) > 0.2 THEN 1 ELSE 0 END AS sentiment_positive,
       CASE WHEN avg(sentiment) < -0.2 THEN 1 ELSE 0 END AS sentiment_negative,
       max(sentiment) - min(sentiment) AS sentiment_range, date_trunc('day', published_date) AS timestamp,
       'sentiment_agg' AS source FROM sn GROUP BY symbol, date_trunc('day', published_date)""",
    "sn",
)(lambda t: nw.daily_sentiment(_by_symbol(t)))
_ROLL = ", ".join(
    f"avg(sentiment_mean) OVER (o ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sentiment_ma_{n}, "
    f"sum(article_count) OVER (o ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sentiment_count_ma_{n}"
    for n in (3, 7, 14)
).replace("(o ROWS", "(PARTITION BY symbol ORDER BY date ROWS")
query(
    "a_sentf",
    "symbol date:t sentiment_mean:6 sentiment_std:6 article_count:i sentiment_confidence:6 positive_count:i "
    + " ".join(f"sentiment_ma_{n}:6 sentiment_count_ma_{n}:i" for n in (3, 7, 14)),
    f"""SELECT *, {_ROLL} FROM (SELECT symbol, date_trunc('day', published_date) AS date, avg(sentiment) AS sentiment_mean,
        stddev_samp(sentiment) AS sentiment_std, count(sentiment) AS article_count,
        avg(sentiment_confidence) AS sentiment_confidence,
        count(*) FILTER (sentiment_label = 'positive') AS positive_count FROM sn GROUP BY ALL)""",
    "sn",
)(lambda t: nw.sentiment_features(_by_symbol(t)))


def _summary_sql(view: str, threshold: float, confidence: str) -> str:
    return f"""SELECT *, total_articles - positive_count - negative_count AS neutral_count, 7 AS period_days,
        CASE WHEN avg_sentiment > 0.2 THEN 'positive' WHEN avg_sentiment < -0.2 THEN 'negative' ELSE 'neutral' END AS trend
        FROM (SELECT symbol, count(*) AS total_articles, avg(sentiment) AS avg_sentiment, {confidence}
        count(*) FILTER (sentiment > {threshold}) AS positive_count, count(*) FILTER (sentiment < -{threshold}) AS negative_count
        FROM {view} WHERE published_date >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY symbol)"""


_SUM = "symbol total_articles:i avg_sentiment:6 avg_confidence:6 positive_count:i negative_count:i neutral_count:i trend period_days:i"
_SUMSQL = _summary_sql("sn", 0.2, "avg(sentiment_confidence) AS avg_confidence,")
_KWSUM = f"""SELECT symbol, string_agg(word, ',' ORDER BY place) AS top_keywords FROM (SELECT symbol, word, row_number() OVER
    (PARTITION BY symbol ORDER BY count(*) DESC, min(row(published_date, doc_id, kwtop.rank))) AS place
    FROM kwtop JOIN sn USING (doc_id) WHERE published_date >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
    GROUP BY symbol, word QUALIFY place <= 10) GROUP BY symbol"""


@query("a_sentsum", _SUM + " top_keywords", f"SELECT * FROM ({_SUMSQL}) JOIN ({_KWSUM}) USING (symbol)", "sn kwtop")
def a_sentsum(t):
    scored = _by_symbol(t)
    top = nw.summary_keywords(nw.clean_news(t.news), "doc_id", _combined(), AS_OF)
    words = top.groupBy("symbol").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",").alias(
            "top_keywords"
        )
    )
    return nw.sentiment_summary(scored, AS_OF).join(words, "symbol")


query("o_senting", _SUM, _SUMSQL, "sn")(lambda t: nw.sentiment_summary(_by_symbol(t), AS_OF))
SQL["basic"] = f"""SELECT n.*, upper(coalesce(symbol, 'MARKET')) AS sym, CASE WHEN up + down > 0 THEN (up - down) /
    CAST(up + down AS DOUBLE) ELSE 0 END AS sentiment FROM news n JOIN ({_POSNEG}) USING (doc_id)"""
NEEDS["basic"] = ["news"]
query(
    "a_sentsum0",
    "symbol total_articles:i avg_sentiment:6 positive_count:i negative_count:i neutral_count:i trend period_days:i",
    _summary_sql("(SELECT * EXCLUDE (symbol, sym), sym AS symbol FROM basic)", 0.1, ""),
    "basic",
)(lambda t: nw.sentiment_summary(nw.clean_news(nw.basic_score(t.news, _BASIC, "content")), AS_OF, threshold=0.1))
query(
    "a_sentts",
    "symbol date:t sentiment:6 sentiment_confidence:6 article_count:i trend",
    f"""SELECT *, CASE WHEN avg(sentiment) OVER (PARTITION BY symbol) > 0.2 THEN 'positive'
        WHEN avg(sentiment) OVER (PARTITION BY symbol) < -0.2 THEN 'negative' ELSE 'neutral' END AS trend
        FROM (SELECT symbol, date_trunc('day', published_date) AS date, avg(sentiment) AS sentiment,
        avg(sentiment_confidence) AS sentiment_confidence, count(title) AS article_count FROM sn
        WHERE published_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL)""",
    "sn",
)(lambda t: nw.sentiment_timeseries(_by_symbol(t), AS_OF))
query(
    "a_newstool",
    "symbol count:i avg_sentiment:6 positive_count:i negative_count:i",
    """SELECT symbol, count(*) AS count, avg(sentiment) AS avg_sentiment, count(*) FILTER (sentiment > 0.2) AS positive_count,
       count(*) FILTER (sentiment < -0.2) AS negative_count FROM sn GROUP BY symbol""",
    "sn",
)(lambda t: nw.article_totals(_by_symbol(t)))


@query(
    "x_sent",
    "doc_id:i sentiment:6 positive_signals:i negative_signals:i",
    """SELECT doc_id, p AS positive_signals, n AS negative_signals, CASE WHEN p + n > 0 THEN (p - n) / CAST(p + n AS DOUBLE) ELSE 0 END AS sentiment
       FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'und'))) AS p, len(list_filter(w, lambda x: x IN ('la', 'de'))) AS n
       FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents))""",
)
def x_sent(t):
    """Scores by word lists of the user's own."""
    own = tx.Lexicon(positive=frozenset(["the", "und"]), negative=frozenset(["la", "de"]))
    return tx.add_sentiment(t.table("documents"), "text", own)
