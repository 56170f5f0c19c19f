"""Order books, trades, indices, macro summaries, messages and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.catalog.base import query
from barlake.functions import parse as ps
from barlake.operators import market as mk
from barlake.plans.views import SQL, NEEDS

SQL["lv"] = """SELECT *, row_number() OVER o AS level, sum(volume) OVER (o ROWS UNBOUNDED PRECEDING) AS cumulative_volume
    FROM (SELECT *, CASE WHEN side = 'bid' THEN -price ELSE price END AS away FROM levels)
    WINDOW o AS (PARTITION BY symbol, timestamp, side ORDER BY away, volume, orders)""".replace(
    "(o ROWS", "(PARTITION BY symbol, timestamp, side ORDER BY away, volume, orders ROWS"
)
NEEDS["lv"] = ["levels"]
SQL["best"] = """SELECT *, best_ask - best_bid AS spread, (best_bid + best_ask) / 2 AS mid_price FROM (
    SELECT symbol, timestamp, coalesce(max(price) FILTER (side = 'bid'), 0.0) AS best_bid,
    coalesce(min(price) FILTER (side = 'ask'), 0.0) AS best_ask FROM levels GROUP BY ALL)"""
NEEDS["best"] = ["levels"]
query("a_book", "symbol timestamp:t best_bid:4 best_ask:4 spread:4 mid_price:4", "SELECT * FROM best", "best")(
    lambda t: mk.best_prices(t.levels)
)
query(
    "w_cumvol",
    "symbol timestamp:t side price:4 volume:i orders:i level:i cumulative_volume:i spread:4 mid_price:4",
    "SELECT lv.*, spread, mid_price FROM lv JOIN best USING (symbol, timestamp)",
    "lv best",
)(lambda t: mk.book_rows(t.levels))
query(
    "a_trade",
    "symbol total_trades:i total_volume:i avg_price:4 max_price:4 min_price:4 buy_volume:i sell_volume:i buy_ratio:6",
    """SELECT *, coalesce(buy_volume / CAST(buy_volume + sell_volume AS DOUBLE), 0.5) AS buy_ratio FROM (
       SELECT symbol, count(*) AS total_trades, sum(volume) AS total_volume, avg(price) AS avg_price,
       max(price) AS max_price, min(price) AS min_price, coalesce(sum(volume) FILTER (side = 'buy'), 0) AS buy_volume,
       coalesce(sum(volume) FILTER (side = 'sell'), 0) AS sell_volume FROM trades GROUP BY ALL)""",
    "trades",
)(lambda t: mk.trade_summary(t.trades))

_CHG = """SELECT *, (close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) - 1) * 100 AS change,
    (close - open) / open * 100 AS change_from_open FROM f2"""
query("a_idxchg", "symbol timestamp:t change:4 change_from_open:4", _CHG, "f2")(lambda t: mk.index_changes(t.indices))
SQL["isum"] = f"""SELECT symbol, max(timestamp) AS timestamp, max_by(close, timestamp) AS close,
    max_by(change, timestamp) AS change_pct, max_by(volume, timestamp) AS volume, max(high) AS high_52w,
    min(low) AS low_52w, max_by(prev, timestamp) AS prev_close FROM (SELECT *, lag(close) OVER
    (PARTITION BY symbol ORDER BY timestamp) AS prev FROM ({_CHG})) GROUP BY symbol"""
NEEDS["isum"] = ["f2"]
_ISUM = "timestamp:t close:2 change_pct:4 volume:2 high_52w:2 low_52w:2"
query("a_idxsum", f"symbol {_ISUM} prev_close:2", "SELECT * FROM isum", "isum")(lambda t: mk.index_summary(t.indices))
query("o_idx_wr", f"index_name source {_ISUM}", "SELECT *, symbol AS index_name, 'market_index' AS source FROM isum", "isum")(
    lambda t: mk.index_features(mk.index_summary(t.indices))
)
query(
    "a_allidx",
    "symbol timestamp:t close:2 change:4 change_from_open:4",
    f"SELECT * FROM ({_CHG}) WHERE timestamp >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY",
    "f2",
)(lambda t: mk.index_history(t.indices, "2001-08-02", 365))
query(
    "a_sector",
    "sector close:2 change_pct:4 year_change_pct:4 volume:2",
    """SELECT symbol AS sector, close, change_pct, (close / first - 1) * 100 AS year_change_pct, volume
       FROM isum JOIN (SELECT symbol, min_by(close, timestamp) AS first FROM (SELECT * FROM f2
       QUALIFY timestamp >= max(timestamp) OVER (PARTITION BY symbol) - INTERVAL 2 YEAR) GROUP BY ALL) USING (symbol)""",
    "isum f2",
)(lambda t: mk.sector_performance(t.indices))
query(
    "a_breadth",
    "timestamp:t advances:i declines:i unchanged:i new_highs:i new_lows:i total_traded:2 market_sentiment",
    """SELECT *, CASE WHEN advances > declines THEN 'positive' WHEN advances < declines THEN 'negative' ELSE 'neutral' END
       AS market_sentiment FROM (SELECT timestamp, count(*) FILTER (close > prev) AS advances,
       count(*) FILTER (close < prev) AS declines, count(*) FILTER (close = prev) AS unchanged,
       count(*) FILTER (close > hi) AS new_highs, count(*) FILTER (close < lo) AS new_lows, sum(volume) AS total_traded
       FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS prev,
       max(close) OVER o AS hi, min(close) OVER o AS lo FROM f2
       WINDOW o AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)) GROUP BY timestamp)""",
    "f2",
)(lambda t: mk.breadth(t.f2))


def _macro(t):
    """Exchange rate, gold by place and oil from orders of three statuses."""
    o = t.table("orders").withColumn("timestamp", F.expr("o_orderdate + make_interval(0, 0, 0, 0, 0, 0, o_orderkey / 1000000.0D)").cast("timestamp"))
    fx = o.filter("o_orderstatus = 'O'").select("timestamp", F.col("o_totalprice").alias("mid_rate"))
    place = F.when(F.col("o_orderpriority") == "5-LOW", "WORLD").otherwise(F.col("o_orderpriority"))
    gold = o.filter("o_orderstatus = 'F'").select("timestamp", F.col("o_totalprice").alias("buy_price"), place.alias("location"))
    oil = o.filter("o_orderstatus = 'P'").select("timestamp", F.col("o_totalprice").alias("price"))
    return mk.macro_summary(fx, gold, oil)


def _newest(status: str, extra: str = "") -> str:
    return f"""(SELECT max_by(o_totalprice, row(o_orderdate, o_orderkey)) FROM orders WHERE o_orderstatus = '{status}' {extra})"""


_MSQL = f"""SELECT 'macro' AS source, {_newest('O')} AS usd_vnd, {_newest('F', "AND o_orderpriority = '5-LOW'")} AS gold_usd_oz,
    {_newest('P')} AS wti_usd_barrel"""
query("j_macrosum", "usd_vnd:2 gold_usd_oz:2 wti_usd_barrel:2", _MSQL)(
    lambda t: _macro(t).select("exchange_rate.usd_vnd", F.col("gold.price_usd_oz").alias("gold_usd_oz"), "oil.wti_usd_barrel")
)
query("o_macro_wr", "source usd_vnd:2 gold_usd_oz:2 wti_usd_barrel:2", _MSQL)(lambda t: mk.macro_features(_macro(t)))

_WORDS = r"""SELECT DISTINCT upper(w) AS symbol FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents)
    WHERE length(w) BETWEEN 2 AND 5"""


def _words(t):
    w = t.table("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w"))
    return w.filter(F.length("w").between(2, 5)).select(F.upper("w").alias("symbol")).distinct()


_LIST = lambda items: ", ".join(f"'{x}'" for x in items)
_MEMBERS = " UNION ".join(
    f"SELECT '{name}' AS index_name, unnest([{_LIST(members)}]) AS symbol" for name, members in mk.INDEX_MEMBERS.items() if members
)
query(
    "o_components",
    "index_name symbol mentioned",
    f"""SELECT m.*, w.symbol IS NOT NULL AS mentioned FROM ({_MEMBERS}) m LEFT JOIN ({_WORDS}) w USING (symbol)""",
)(
    lambda t: mk.index_components(t.spark)
    .join(_words(t).withColumn("hit", F.lit(True)), "symbol", "left")
    .withColumn("mentioned", F.coalesce("hit", F.lit(False)))
)
query("j_semi", "symbol timestamp:t close:2", "SELECT f2.* FROM f2 SEMI JOIN (SELECT * FROM sector_of WHERE sector = 'FIN') USING (symbol)", "f2 sector_of")(
    lambda t: mk.in_universe(t.f2, t.sector_of.filter("sector = 'FIN'"))
)
query(
    "f_ysym",
    "symbol market_symbol",
    f"SELECT symbol, CASE WHEN symbol IN ({_LIST(mk.SUFFIXED)}) THEN symbol || '.VN' ELSE symbol END AS market_symbol FROM ({_WORDS})",
)(lambda t: _words(t).withColumn("market_symbol", mk.market_symbol()))


def _rules(t):
    mean = t.f1.groupBy("symbol").agg(F.avg("close").alias("m"))
    each = F.explode(F.array(F.struct(F.lit("above").alias("condition"), (F.col("m") * 1.9).alias("threshold")),
                             F.struct(F.lit("below").alias("condition"), (F.col("m") * 0.05).alias("threshold"))))
    return mean.select("symbol", each.alias("r")).select("symbol", "r.*")


query(
    "o_alert",
    "type symbol price:4 condition message timestamp:t",
    """SELECT 'alert' AS type, symbol, close AS price, condition, symbol || ' close is ' || condition || ' the limit' AS message,
       timestamp FROM f1 JOIN (SELECT symbol, 'above' AS condition, avg(close) * 1.9 AS threshold FROM f1 GROUP BY symbol
       UNION ALL SELECT symbol, 'below', avg(close) * 0.05 FROM f1 GROUP BY symbol) r USING (symbol)
       WHERE (condition = 'above' AND close > threshold) OR (condition = 'below' AND close < threshold)""",
    "f1",
)(lambda t: mk.alerts(t.f1, _rules(t)))
query(
    "o_envelope",
    "symbol messages:i bars:i first:t last:t volume:2",
    """SELECT symbol, CAST(ceil(count(*) / 200.0) AS BIGINT) AS messages, count(*) AS bars, min(timestamp) AS first,
       max(timestamp) AS last, sum(volume) AS volume FROM f1 GROUP BY symbol""",
    "f1",
)(
    lambda t: (lambda m: mk.open_envelopes(m, "timestamp timestamp, open double, high double, low double, close double, volume double")
    .groupBy("symbol")
    .agg(F.count(F.lit(1)).alias("bars"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.sum("volume").alias("volume"))
    .join(m.groupBy(F.col("key").alias("symbol")).agg(F.count(F.lit(1)).alias("messages")), "symbol"))(
        mk.envelopes(t.f1, ["open", "high", "low", "close", "volume"], 200)
    )
)
query(
    "f_json",
    "event_id:i k:i again",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS again
       FROM events""",
)(
    lambda t: t.table("events")
    .withColumn("p", F.from_json("props", "k bigint"))
    .select("event_id", "p.k", F.to_json("p").alias("again"))
)

# --- parsers over texts made from order numbers ------------------------------------------------------

_N = "CAST(o_orderkey * 37 % 10000000 AS BIGINT)"
_NUM = f"""CASE o_orderkey % 5 WHEN 0 THEN printf('%d.%03d VND', {_N} // 1000, {_N} % 1000)
    WHEN 1 THEN printf('$%d,%03d USD', {_N} // 1000, {_N} % 1000) WHEN 2 THEN printf('%d.%02d', {_N} // 100, {_N} % 100)
    WHEN 3 THEN 'n/a' ELSE printf('₫ %d', {_N}) END"""


def _number_text():
    n = (F.col("o_orderkey") * 37 % 10000000).cast("long")
    div = lambda d: F.floor(n / d)
    kind = F.col("o_orderkey") % 5
    return (
        F.when(kind == 0, F.format_string("%d.%03d VND", div(1000), n % 1000))
        .when(kind == 1, F.format_string("$%d,%03d USD", div(1000), n % 1000))
        .when(kind == 2, F.format_string("%d.%02d", div(100), n % 100))
        .when(kind == 3, F.lit("n/a"))
        .otherwise(F.format_string("₫ %d", n))
    )


query(
    "f_num_vn",
    "run:i raw value:4",
    f"""SELECT o_orderkey AS run, {_NUM} AS raw, CASE o_orderkey % 5 WHEN 2 THEN {_N} / 100.0 WHEN 3 THEN NULL ELSE {_N} END AS value
        FROM orders""",
)(lambda t: t.table("orders").select(F.col("o_orderkey").alias("run"), _number_text().alias("raw")).withColumn("value", ps.local_number("raw")))
query(
    "f_num_pct",
    "run:i value:4",
    f"SELECT o_orderkey AS run, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {_N} + 0.25 END AS value FROM orders",
)(
    lambda t: t.table("orders").select(
        F.col("o_orderkey").alias("run"),
        ps.percent_number(
            F.when(F.col("o_orderkey") % 7 == 0, "-").otherwise(
                F.format_string(" %,d.25%% ", (F.col("o_orderkey") * 37 % 10000000).cast("long"))
            )
        ).alias("value"),
    )
)
query(
    "f_date",
    "run:i at:t",
    """SELECT o_orderkey AS run, CASE WHEN o_orderkey % 5 = 4 THEN TIMESTAMP '2024-06-01' ELSE date_trunc('day', o_orderdate)
       + CASE WHEN o_orderkey % 5 IN (0, 2) THEN INTERVAL 570 MINUTE ELSE INTERVAL 0 MINUTE END END AS at FROM orders""",
)(
    lambda t: t.table("orders").select(
        F.col("o_orderkey").alias("run"),
        ps.date_time(
            F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "dd/MM/yyyy' 09:30'"))
            .when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(F.col("o_orderkey") % 5 == 2, F.date_format("o_orderdate", "yyyy-MM-dd' 09:30:00'"))
            .when(F.col("o_orderkey") % 5 == 3, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .otherwise("soon"),
            "2024-06-01",
        ).alias("at"),
    )
)
query(
    "f_rel",
    "run:i at:t",
    """SELECT o_orderkey AS run, TIMESTAMP '2024-06-01' - CASE o_orderkey % 4 WHEN 0 THEN to_hours(24 * n) WHEN 1 THEN
       to_hours(168 * n) WHEN 2 THEN to_hours(n) ELSE to_hours(0) END AS at
       FROM (SELECT o_orderkey, CAST(o_orderkey % 90 AS INTEGER) AS n FROM orders)""",
)(
    lambda t: t.table("orders").select(
        F.col("o_orderkey").alias("run"),
        ps.relative_time(
            F.concat(
                (F.col("o_orderkey") % 90).cast("string"),
                F.element_at(F.array(*map(F.lit, ["D", "w", "h", "x"])), (F.col("o_orderkey") % 4 + 1).cast("int")),
            ),
            "2024-06-01",
        ).alias("at"),
    )
)
