"""Payload and page readers over documents that Spark makes from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.catalog.base import query
from barlake.operators.market import flatten_book, number_levels
from barlake.sources import pages as pg
from barlake.sources import payloads as pl

_BAR = "symbol timestamp:t open:4 high:4 low:4 close:4 adj_close:4 volume:4"
_F1 = "SELECT *, close AS adj_close FROM f1"


def _daily_lists(bars, *columns):
    """One row per (symbol, day) with the day's bars as a list (24 hourly bars at most)."""
    item = F.struct("timestamp", *columns)
    return bars.groupBy("symbol", F.to_date("timestamp").alias("day")).agg(F.array_sort(F.collect_list(item)).alias("rows"))


def _chart(t):
    names = ["open", "high", "low", "close", "volume"]
    days = _daily_lists(t.f1, *names)
    pick = lambda c: F.transform("rows", lambda r: r[c]).alias(c)
    at = F.transform("rows", lambda r: F.unix_seconds(r["timestamp"])).alias("timestamp")
    indicators = F.struct(
        F.array(F.struct(*map(pick, names))).alias("quote"), F.array(F.struct(pick("close").alias("adjclose"))).alias("adjclose")
    )
    result = F.struct(at, indicators.alias("indicators"))
    return days.select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))


query("o_chartjson", _BAR, _F1, "f1")(lambda t: pl.chart_rows(_chart(t)))


def _history(t):
    money = lambda c, r: F.format_string("%,.2f", r[c])
    bars = t.f1.select("symbol", "timestamp", "open", "high", "low", "close", "volume")
    days = _daily_lists(bars, "open", "high", "low", "close", "volume")
    item = lambda r: F.struct(
        F.date_format(r["timestamp"], "dd/MM/yyyy HH:mm:ss").alias("Date"),
        money("open", r).alias("Open"), money("high", r).alias("High"), money("low", r).alias("Low"),
        money("close", r).alias("Close"), money("close", r).alias("AdjustPrice"), money("volume", r).alias("Volume"),
    )
    broken = F.struct(*[F.lit("?").alias(c) for c in ("Date", "Open", "High", "Low", "Close", "AdjustPrice", "Volume")])
    data = F.array_append(F.transform("rows", item), broken)
    return days.select("symbol", F.to_json(F.struct(data.alias("data"))).alias("payload"))


query("o_rowjson", _BAR, _F1, "f1")(lambda t: pl.history_rows(_history(t)))


def _dated(t):
    """One date-keyed document per (symbol, month): 31 days at most."""
    entry = F.create_map(
        F.lit("1. open"), F.col("open").cast("string"), F.lit("2. high"), F.col("high").cast("string"),
        F.lit("3. low"), F.col("low").cast("string"), F.lit("4. close"), F.col("close").cast("string"),
        F.lit("6. volume"), F.col("volume").cast("string"),
    )
    rows = t.f2.select("symbol", F.trunc("timestamp", "month").alias("m"), F.struct(F.date_format("timestamp", "yyyy-MM-dd"), entry).alias("e"))
    docs = rows.groupBy("symbol", "m").agg(F.map_from_entries(F.collect_list("e")).alias("days"))
    return docs.select(
        "symbol",
        F.to_json(F.struct(F.create_map(F.lit("1. Information"), F.lit("Daily")).alias("Meta Data"), F.col("days").alias("Time Series (Daily)"))).alias("payload"),
    )


query(
    "o_mapjson",
    "symbol timestamp:t open:2 high:2 low:2 close:2 adj_close:2 volume:2",
    """SELECT upper(symbol) AS symbol, * EXCLUDE (symbol), close AS adj_close FROM f2
       WHERE timestamp > TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '1999-01-01'""",
    "f2",
)(lambda t: pl.series_rows(_dated(t), "1996-01-01", "1999-01-01"))
query("o_yf", _BAR + " source", f"SELECT *, 'vendor' AS source FROM ({_F1})", "f1")(
    lambda t: pl.vendor_bars(
        t.f1.withColumnsRenamed({"timestamp": "Datetime", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume"}),
        "vendor",
    )
)


def _books(t):
    """One payload per (symbol, month) snapshot with all levels of both sides."""
    best = number_levels(t.levels)
    entry = F.struct("level", F.col("price").alias("Price"), F.col("volume").alias("Volume"), F.col("orders").alias("Orders"))
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, entry)))
    books = best.groupBy("symbol", "timestamp").agg(side("bid").alias("Buy"), side("ask").alias("Sell"))
    return books.select("symbol", "timestamp", F.to_json(F.struct("Buy", "Sell")).alias("payload"))


query(
    "o_objson",
    "symbol timestamp:t side level:i price:4 volume:i orders:i cumulative_volume:i",
    "SELECT * FROM lv",
    "lv",
)(lambda t: flatten_book(pl.book_snapshots(_books(t))))


def _prints(t):
    """One payload per order and symbol with its trades, seven at most."""
    entry = F.struct(
        F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("Time"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"),
        F.col("l_quantity").cast("long").alias("Volume"),
        F.when(F.col("l_linestatus") == "O", "KL").otherwise("TT").alias("Type"),
    )
    orders = t.table("lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("symbol")).agg(F.collect_list(entry).alias("Data"))
    return orders.select("symbol", F.to_json(F.struct("Data")).alias("payload"))


query("o_prints", "symbol timestamp:t price:4 volume:i side", "SELECT * FROM trades", "trades")(
    lambda t: pl.trade_rows(_prints(t), "2024-02-01")
)


def _statements(t):
    """Quarterly totals of each order priority as an income statement payload."""
    q = t.table("orders").groupBy(
        F.col("o_orderpriority").alias("symbol"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("q")
    ).agg(F.sum("o_totalprice").alias("revenue"), F.max("o_totalprice").alias("profit"))
    # One list per symbol: four quarters a year, however many orders there are.
    period = F.struct((-F.unix_date("q")).alias("k"), F.date_format("q", "yyyy-MM-dd").alias("period"), "revenue", "profit")
    raw = lambda c: F.struct(c.alias("raw"))
    entry = lambda p: F.create_map(
        p["period"], F.create_map(F.lit("totalRevenue"), raw(p["revenue"]), F.lit("grossProfit"), raw(p["profit"]))
    )
    lists = q.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(period)), entry).alias("incomeStatementHistory"))
    inner = F.struct(F.struct("incomeStatementHistory").alias("incomeStatementHistory"))
    return lists.select("symbol", F.to_json(F.struct(F.struct(F.array(inner).alias("result")).alias("chart"))).alias("payload"))


query(
    "o_stmt",
    "symbol period timestamp:t total_revenue:0 gross_profit:2 net_income:2",
    """SELECT upper(o_orderpriority) AS symbol, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period,
       date_trunc('quarter', o_orderdate) AS timestamp, sum(o_totalprice) AS total_revenue, max(o_totalprice) AS gross_profit,
       CAST(NULL AS DOUBLE) AS net_income FROM orders GROUP BY 1, 2, 3""",
)(lambda t: pl.statement_rows(_statements(t), "income"))


def _ratios(t):
    raw = lambda c: F.struct(c.alias("raw"))
    s = t.table("supplier")
    summary = F.create_map(F.lit("trailingPE"), raw(F.col("s_acctbal") / 100), F.lit("marketCap"), raw(F.col("s_acctbal") * 1000))
    stats = F.create_map(F.lit("trailingEps"), raw(F.col("s_suppkey").cast("double")))
    result = F.struct(summary.alias("summaryDetail"), stats.alias("defaultKeyStatistics"))
    doc = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("quoteSummary")))
    return s.select(F.col("s_name").alias("symbol"), F.when(F.col("s_suppkey") % 10 != 0, doc).otherwise("{}").alias("payload"))


query(
    "o_fundmet",
    "symbol pe_ratio:4 market_cap:2 eps:2 roe:2 dps:2",
    """SELECT upper(s_name) AS symbol, CASE WHEN f THEN s_acctbal / 100 END AS pe_ratio, CASE WHEN f THEN s_acctbal * 1000 END AS market_cap,
       CASE WHEN f THEN CAST(s_suppkey AS DOUBLE) END AS eps, CAST(NULL AS DOUBLE) AS roe, CAST(NULL AS DOUBLE) AS dps
       FROM (SELECT *, s_suppkey % 10 <> 0 AS f FROM supplier)""",
)(lambda t: pl.ratio_rows(_ratios(t)))
query(
    "o_fund_wr",
    "symbol pe_ratio:4 period:t year:i quarter:i",
    "SELECT upper(symbol) AS symbol, pe_ratio, period, year(period) AS year, quarter(period) AS quarter FROM fundamentals",
    "fundamentals",
)(lambda t: pl.fundamentals(t.fundamentals))

# --- pages -----------------------------------------------------------------------------------------------


def _price_pages(t):
    """One price page per (symbol, month)."""
    money = lambda c, r: F.format_string("%,.2f", r[c])
    rows = t.f2.groupBy("symbol", F.trunc("timestamp", "month").alias("m")).agg(
        F.array_sort(F.collect_list(F.struct("timestamp", "open", "high", "low", "close", "volume"))).alias("rows")
    )
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit("</td>"))
    line = lambda r: F.concat(
        F.lit("<tr>"), cell(F.date_format(r["timestamp"], "dd/MM/yyyy")), *[cell(money(c, r)) for c in ("open", "high", "low", "close")],
        cell(F.format_string("%,d", r["volume"].cast("long"))), F.lit("</tr>"),
    )
    html = F.concat(
        F.lit('<html><script>var t="</td>";</script><table id="table1"><tr><th>Date</th></tr>'),
        F.array_join(F.transform("rows", line), "\n"),
        F.lit("<tr><td>total</td><td>1</td><td>1</td><td>1</td><td>1</td><td>1</td></tr></table><table><tr><td>x</td></tr></table>"),
    )
    return rows.select("symbol", html.alias("html"))


query(
    "o_htmlprice",
    "symbol timestamp:t open:2 high:2 low:2 close:2 adj_close:2 volume:2",
    "SELECT *, close AS adj_close FROM f2",
    "f2",
)(lambda t: pg.price_rows(_price_pages(t)))
query(
    "x_html",
    "symbol day cells:i volume",
    """SELECT symbol, strftime(timestamp, '%d/%m/%Y') AS day, 6 AS cells, CAST(CAST(volume AS BIGINT) AS VARCHAR) AS volume FROM f2
       UNION ALL SELECT symbol, 'total', 6, '1' FROM f2 GROUP BY symbol, date_trunc('month', timestamp)""",
    "f2",
)(
    lambda t: pg.cell_rows(_price_pages(t), "symbol", table_id="table1")
    .filter(F.size("cells") > 0)
    .select("symbol", F.col("cells")[0].alias("day"), F.size("cells").alias("cells"), F.replace(F.col("cells")[5], F.lit(","), F.lit("")).alias("volume"))
)
# The articles of the pages have no h3, a, h2, date or inner content block: title, link and date are empty.
query(
    "o_htmlnews",
    "page_id:i item:i title link date_text content",
    """SELECT page_id, 0 AS item, '' AS title, '' AS link, '' AS date_text, regexp_replace(replace(replace(replace(array_to_string(
       list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '<[^>]*>'),
       lambda x: trim(x, chr(10) || chr(13) || chr(9) || ' ')), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g')
       AS content FROM pages""",
)(lambda t: pg.news_rows(t.table("pages")))


def _ratio_pages(t):
    s = t.table("supplier")
    row = lambda label, value: F.concat(F.lit(f"<tr><td>{label}</td><td>"), value, F.lit("</td></tr>"))
    money = F.format_string("%,.2f", F.col("s_acctbal"))
    html = F.concat(
        F.lit("<table class='financial-table'>"), row("Hệ số P/E", money), row("EPS cơ bản", F.col("s_suppkey").cast("string")),
        row("EPS pha loãng", F.lit("7")), row("ROE (%)", F.concat(F.col("s_nationkey").cast("string"), F.lit("%"))), F.lit("</table>"),
    )
    return s.select(F.col("s_name").alias("symbol"), html.alias("html"))


@query(
    "o_htmlkv",
    "symbol pe_ratio:2 eps:2 roe:2 last_eps:2 last_pe:2",
    """SELECT s_name AS symbol, s_acctbal AS pe_ratio, CAST(s_suppkey AS DOUBLE) AS eps, CAST(s_nationkey AS DOUBLE) AS roe,
       7.0 AS last_eps, s_acctbal AS last_pe FROM supplier""",
)
def o_htmlkv(t):
    pages = _ratio_pages(t)
    last = pg.summary_page_rows(pages).select("symbol", F.col("eps").alias("last_eps"), F.col("pe_ratio").alias("last_pe"))
    return pg.ratio_page_rows(pages).join(last, "symbol")


def _rate_pages(t):
    """Nations as rows of a rate table; every seventh has no usable number."""
    n = t.table("nation")
    value = F.when(F.col("n_nationkey") % 7 == 0, "n/a").otherwise(F.format_string("%d,%03d VND", F.col("n_nationkey"), F.col("n_regionkey")))
    html = F.concat(
        F.lit("<table><tr><td>"), "n_name", F.lit(" USD</td><td>"), value, F.lit("</td><td>"), F.col("n_regionkey").cast("string"),
        F.lit("</td></tr></table>"),
    )
    return n.select(F.col("n_nationkey").cast("long").alias("page_id"), html.alias("html"))


_CELLS = """SELECT n_name || ' USD' AS label, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) * 1000 + n_regionkey END
    AS first, CAST(n_regionkey AS DOUBLE) AS second FROM nation"""


@query(
    "o_macrotab",
    "family name value:6 unit",
    f"""SELECT 'fx' AS family, 'USD/VND' AS name, CASE WHEN first <> 0 AND second <> 0 THEN (first + second) / 2 END AS value,
        NULL AS unit FROM ({_CELLS})
        UNION ALL SELECT 'gold', label, first, 'VND/luong' FROM ({_CELLS}) WHERE first <> 0 AND second <> 0
        UNION ALL SELECT 'rate', label, first / 100, 'percent' FROM ({_CELLS}) WHERE first <> 0
        UNION ALL SELECT 'cpi', label, first, 'index' FROM ({_CELLS}) WHERE first <> 0
        UNION ALL SELECT 'none', unnest(['OMO', 'REPO', 'DEPOSIT_12M']), unnest([0.045, 0.04, 0.055]), 'percent'""",
)
def o_macrotab(t):
    """Typed rows of the macro tables; `none` are the default rates for cells without any number."""
    now = "2024-02-01"
    cells = pg.number_cells(_rate_pages(t), now)
    row = lambda df, family, name, value, unit: df.select(
        F.lit(family).alias("family"), F.col(name).alias("name"), F.col(value).alias("value"), unit.alias("unit")
    )
    return (
        row(pl.fx_rows(cells), "fx", "currency_pair", "mid_rate", F.lit(None).cast("string"))
        .unionByName(row(pl.gold_rows(cells), "gold", "location", "buy_price", F.col("unit")))
        .unionByName(row(pl.rate_rows(cells, now), "rate", "rate_type", "rate_value", F.col("unit")))
        .unionByName(row(pl.cpi_rows(cells, now), "cpi", "period", "value", F.col("unit")))
        .unionByName(row(pl.rate_rows(cells.filter("first IS NULL"), now, defaults=True), "none", "rate_type", "rate_value", F.col("unit")))
    )
