"""Literal payloads, pages, numbers and dates."""

import json
import re
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from barlake.functions import parse as ps
from barlake.operators.market import SNAPSHOT, flatten_book
from barlake.sources import files, pages, payloads
from tests.conftest import collect, make_bars
from tools.check import rows_of


def payload(spark, *docs):
    rows = [("vnm", "2024-01-02 00:00:00", d if isinstance(d, str) else json.dumps(d)) for d in docs]
    return spark.createDataFrame(rows, "symbol string, timestamp string, payload string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))


CHART = {
    "chart": {"result": [{"timestamp": [0, 86400, 172800], "indicators": {"quote": [
        {"open": [1, 2, 3], "high": [1, 2, 3], "low": [1, 2, 3], "close": [1.5, None, 3.5], "volume": [10, 20, 30]}]}}]}
}


def test_chart(spark):
    rows = collect(payloads.chart_rows(payload(spark, CHART)), "timestamp")
    assert len(rows) == 3 and rows["symbol"][0] == "VNM" and rows["adj_close"][2] == 3.5
    assert payloads.chart_rows(payload(spark, CHART), drop_empty_close=True).count() == 2
    assert payloads.chart_rows(payload(spark, {}, "no json", {"chart": {"result": []}})).count() == 0


def test_history(spark):
    item = {"Date": "31/12/2023 00:00:00", "Open": "1,234.5", "High": "2", "Low": "1", "Close": "1.5", "AdjustPrice": "", "Volume": "1,000"}
    rows = payloads.history_rows(payload(spark, {"data": [item, {**item, "Date": "x"}, {**item, "Open": "x"}]})).collect()
    assert len(rows) == 1 and rows[0]["open"] == 1234.5 and rows[0]["adj_close"] == 0.0 and str(rows[0]["timestamp"]) == "2023-12-31 00:00:00"


def test_date_keyed(spark):
    days = {f"2024-01-0{d}": {"1. open": "1", "2. high": "2", "3. low": "0.5", "4. close": str(d), "6. volume": "7"} for d in (5, 4, 3, 2)}
    doc = {"Meta Data": {"1. Information": "x"}, "Time Series (Daily)": days}
    rows = collect(payloads.series_rows(payload(spark, doc), "2024-01-02", "2024-01-05"), "timestamp")
    assert rows["close"].tolist() == [3.0, 4.0] and rows["adj_close"].tolist() == [3.0, 4.0]


@pytest.mark.parametrize("layout,doc", [
    ("first", {"Buy": [{"Price": 10, "Volume": 5}, {"Price": 10, "Volume": 5}, {"Price": 9, "Volume": 1}], "Sell": []}),
    ("second", {"bids": [{"price": 10, "vol": 5}, {"price": 10, "vol": 5}, {"price": 9, "vol": 1}]}),
])
def test_book(spark, layout, doc):
    book = payloads.book_snapshots(payload(spark, doc), layout, depth=2)
    row = book.first()
    assert (row["best_bid"], row["best_ask"], row["spread"], row["mid_price"]) == (10.0, 0.0, -10.0, 5.0)
    rows = collect(flatten_book(book), "level")
    assert rows["cumulative_volume"].tolist() == [5, 10]  # by position, also for equal levels
    assert rows["orders"].tolist() == [1, 1]


def test_deep_book(spark):
    """Running volumes of deep books by position, null from a null on; no level row carries the levels of its side."""
    rng = np.random.default_rng(4)
    side = lambda n: [(float(p), int(v), 1) for p, v in zip(rng.integers(1, 99, n), rng.integers(-9, 99, n))]
    books = {f"B{n}": (side(n), side(n + 1)) for n in (0, 1, 2, 3, 4, 7, 8, 9, 31, 32, 33, 1000, 4097)}
    books["NULL"] = ([(1.0, 5, 1), (2.0, None, 1), (3.0, 4, 1)], None)
    day = datetime(2024, 1, 2)
    level = "array<struct<price: double, volume: bigint, orders: bigint>>"
    nested = spark.createDataFrame([(k, day, *v) for k, v in books.items()] * 2, f"symbol string, timestamp timestamp, bids {level}, asks {level}")
    flat = flatten_book(nested)
    want = []
    for k, sides in books.items():
        for name, levels in zip(("bid", "ask"), sides):
            total = 0
            for i, (p, v, o) in enumerate(levels or []):
                total = None if total is None or v is None else total + v
                want += [(k, day, name, i + 1, p, v, o, total)] * 2  # two snapshots under one key stay apart
    assert flat.columns == [*SNAPSHOT, "side", "level", "price", "volume", "orders", "cumulative_volume"]
    assert sorted(map(tuple, flat.collect()), key=repr) == sorted(want, key=repr)
    plan = flat._jdf.queryExecution().sparkPlan().toString()
    carried = re.findall(r"Generate posexplode\(.*\), \[([^]]*)], false", plan)
    assert len(carried) == 1 and "side" in carried[0] and "levels" not in carried[0], plan


def test_trades(spark):
    doc = {"Data": [{"Time": "09:15:00", "Price": 10.5, "Volume": 3, "Type": "KL"}, {"Time": "", "Price": 11, "Volume": 4, "Type": "X"}]}
    rows = payloads.trade_rows(payload(spark, doc), "2024-05-01").collect()
    assert [(r["side"], str(r["timestamp"])) for r in rows] == [("buy", "1900-01-01 09:15:00"), ("sell", "2024-05-01 00:00:00")]


def test_statements_and_ratios(spark):
    doc = {"chart": {"result": [{"balanceSheetHistory": {"balanceSheetStatements": [{"2023-12-31": {"totalAssets": {"raw": 5.0}, "cash": {}}}]}}]}}
    row = payloads.statement_rows(payload(spark, doc), "balance").first()
    assert row["total_assets"] == 5.0 and row["cash"] is None and row["period"] == "2023-12-31"
    doc = {"quoteSummary": {"result": [{"summaryDetail": {"trailingPE": {"raw": 12.5}}, "financialData": {"returnOnEquity": {"raw": 0.2}}}]}}
    row = payloads.ratio_rows(payload(spark, doc)).first()
    assert row["pe_ratio"] == 12.5 and row["roe"] == 0.2 and row["eps"] is None
    assert payloads.ratio_rows(payload(spark, {})).first()["pe_ratio"] is None


def test_vendor_names(spark):
    raw = spark.createDataFrame(make_bars(2)).select(
        "symbol", F.col("timestamp").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"),
    )
    rows = collect(payloads.vendor_bars(raw, "vendor"), "timestamp")
    assert (rows["adj_close"] == rows["close"]).all() and (rows["source"] == "vendor").all()


def test_numbers(spark):
    texts = ["1.234.567", "1,234.5", "25.40", "₫ 1.500", "$12", "x", "", None, "12 345 VND"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ps.local_number("t")).collect()] == [1234567, 1234.5, 25.4, 1500, 12, None, None, None, 12345]
    df = spark.createDataFrame([("12.5%",), ("1,200",), ("-",)], "t string")
    assert [r[0] for r in df.select(ps.percent_number("t")).collect()] == [12.5, 1200, None]


def test_dates(spark):
    texts = ["05/02/2024 10:30", "05/02/2024", "2024-02-05 01:02:03", " 2024-02-05 ", "soon", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) for r in df.select(ps.date_time("t", "2020-01-01")).collect()]
    assert got == ["2024-02-05 10:30:00", "2024-02-05 00:00:00", "2024-02-05 01:02:03", "2024-02-05 00:00:00"] + ["2020-01-01 00:00:00"] * 2
    df = spark.createDataFrame([("3d",), ("1W",), ("2h",), ("x",)], "t string")
    got = [str(r[0]) for r in df.select(ps.relative_time("t", "2024-01-10")).collect()]
    assert got == ["2024-01-07 00:00:00", "2024-01-03 00:00:00", "2024-01-09 22:00:00", "2024-01-10 00:00:00"]


PAGE = """<html><body><script>var a = "<td>no</td>";</script>
<table id="other"><tr><td>1</td></tr></table>
<table id="table1"><tr><th>Ngày</th></tr>
<tr><td>02/01/2024</td><td>1,000.5</td><td>2</td><td>1</td><td>1.5</td><td>1.234,000</td></tr>
<tr><td>bad</td><td>1</td><td>2</td><td>1</td><td>1.5</td><td>10</td></tr></table></body></html>"""


def test_price_page(spark):
    df = spark.createDataFrame([("VNM", PAGE), ("EMPTY", "<p>none</p>"), ("NULL", None)], "symbol string, html string")
    rows = pages.price_rows(df).collect()
    assert len(rows) == 1 and rows[0]["open"] == 1000.5 and rows[0]["volume"] == 1234000.0


def test_news_page(spark):
    html = """<div class="news-item hot"><h3> VNM up </h3><a href="/a.chn">more</a><span class="date">05/02/2024</span>
    <div class="content"><p>Body <b>text</b></p><style>p{}</style></div></div><article><h2>ignored</h2></article>"""
    df = spark.createDataFrame([(1, "https://news.example/x/y", html)], "page_id long, url string, html string")
    row = pages.news_rows(df).first()
    assert row["title"] == "VNM up" and row["link"] == "https://news.example/a.chn" and row["date_text"] == "05/02/2024"
    assert row["content"] == "Bodytext"


def test_label_value_pages(spark):
    html = "<table class='financial-table'><tr><td>EPS (năm)</td><td>5.000</td></tr><tr><td>EPS quý</td><td>1.200</td></tr><tr><td>P/E</td><td>12%</td></tr><tr><td>one</td></tr></table>"
    df = spark.createDataFrame([("VNM", html)], "symbol string, html string")
    first, last = pages.ratio_page_rows(df).first(), pages.summary_page_rows(df).first()
    assert first["eps"] == 5.0 and first["pe_ratio"] == 12.0 and first["roe"] is None
    assert last["eps"] == 1200.0


def test_rate_fallback(spark):
    cells = spark.createDataFrame([(1, "<table><tr><td>Refi</td><td>4.5</td></tr></table>")], "page_id long, html string")
    rows = payloads.rate_rows(pages.number_cells(cells, "2024-01-01"), "2024-01-01").collect()
    assert [(r["rate_type"], r["rate_value"]) for r in rows] == [("Refi", 0.045)]
    assert not rows[0]["is_default"]
    # no row is made up unless asked for, and then it says so
    none = pages.number_cells(cells.filter("false"), "2024-01-01")
    assert payloads.rate_rows(none, "2024-01-01").count() == 0 and payloads.cpi_rows(none, "2024-01-01").count() == 0
    assert [r["is_default"] for r in payloads.rate_rows(none, "2024-01-01", defaults=True).collect()] == [True] * 3
    cpi = payloads.cpi_rows(none, "2024-01-01", defaults=True).first()
    assert cpi["value"] == 100 and cpi["period"] == "2024-01" and cpi["is_default"]


@pytest.mark.parametrize("keys", [range(9), [1, 2, 3], [0, 7], []])
def test_macro_tables_have_default_rates(spark, tmp_path, keys):
    # some, all or no cells with a number, and no cells: default rates come wherever no rate was read
    nations = [(k, f"N{k}", k % 5) for k in keys]
    spark.createDataFrame(nations, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW nation AS SELECT * FROM read_parquet('{tmp_path}/nation.parquet/*.parquet')")
    df, rel = entry_module.queries()["o_macrotab"](spark, str(tmp_path)), con.sql(entry_module.oracle_sql()["o_macrotab"])
    rows = df.collect()
    none = {(r["name"], r["value"], r["unit"]) for r in rows if r["family"] == "none"}
    assert none == {("OMO", 0.045, "percent"), ("REPO", 0.04, "percent"), ("DEPOSIT_12M", 0.055, "percent")}
    assert sum(r["family"] == "rate" for r in rows) == sum(k % 7 != 0 for k in keys)
    assert rows_of(df.columns, [tuple(r) for r in rows]) == rows_of(rel.columns, rel.fetchall())


def test_files(spark, tmp_path):
    pdf = make_bars(30)
    pdf[files.CSV_COLUMNS].to_csv(tmp_path / "AAPL_1d.csv", index=False)
    pdf[files.CSV_COLUMNS].to_csv(tmp_path / "MSFT_1h.csv", index=False)
    df = files.read_bar_files(spark, f"{tmp_path}/*.csv", start="2024-01-10", end="2024-01-20")
    got = {(r["symbol"], r["interval"]): r["count"] for r in df.groupBy("symbol", "interval").count().collect()}
    inside = int(pdf["timestamp"].between("2024-01-10", "2024-01-20").sum())
    assert got == {("AAPL", "1d"): inside, ("MSFT", "1h"): inside}
    files.export_csv(spark.createDataFrame(pdf), str(tmp_path / "out"))
    again = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out"))
    assert again.count() == 30 and set(again.columns) == {"symbol", *files.CSV_COLUMNS}


def test_deep_pages():
    from barlake.sources.pages import news_items, parse_html

    assert parse_html("<p>" * 100_000 + "end").text() == "end"
    body = "word " * 2_000
    assert news_items(f"<article>{body}</article>", "http://x")[0][3] == body.strip()
