"""Stored HTML pages to rows: price tables, label/value tables, news items.

Python does only the markup walk, one page at a time inside Arrow batches; typing, filtering and
matching are column expressions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.parse import local_number, percent_number
from barlake.schemas import FUNDAMENTAL_METRICS

# The page walk travels with its task, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = {"br", "img", "meta", "link", "hr", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
HIDDEN = {"script", "style"}


class Element:
    """Tag with attributes, children and text pieces in order."""

    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def walk(self) -> Iterator["Element"]:
        left = [iter(self.parts)]
        while left:
            part = next(left[-1], None)
            if part is None:
                left.pop()
            elif isinstance(part, Element):
                yield part
                left.append(iter(part.parts))

    def find(self, tag: str, cls: str | None = None, id_: str | None = None) -> "Element | None":
        return next(self.find_all(tag, cls, id_), None)

    def find_all(self, tag: str, cls: str | None = None, id_: str | None = None) -> Iterator["Element"]:
        for e in self.walk():
            if e.tag != tag or (id_ is not None and e.attrs.get("id") != id_):
                continue
            if cls is None or cls in (e.attrs.get("class") or "").split():
                yield e

    def text(self) -> str:
        """Stripped text pieces joined without a separator."""
        pieces, left = [], [iter(self.parts)]
        while left:
            part = next(left[-1], None)
            if part is None:
                left.pop()
            elif isinstance(part, str):
                pieces.append(part.strip())
            elif part.tag not in HIDDEN:
                left.append(iter(part.parts))
        return "".join(pieces)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse_html(html: str) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# --- page walks: HTML text to plain tuples ---------------------------------------------------------------


def table_cells(html: str, table_id: str | None = None, cls: str | None = None) -> list[list[str]]:
    """Cell texts of every body row of the first matching table, or of all tables without a filter."""
    root = parse_html(html)
    tables = list(root.find_all("table", cls, table_id))
    if table_id is not None:
        tables = tables[:1]
    return [[c.text() for c in row.find_all("td")] for t in tables for row in t.find_all("tr")]


def news_items(html: str, base: str, longest: int | None = None) -> list[tuple[str, str, str, str]]:
    """(title, link, date text, body) of the news items on a page; `longest` cuts the body if given.

    Items are `div.news-item`, else `li.news`, else `article`. The title is the first h3, else a, else
    h2. The body is `div.content`, `article` or `div#content` inside the item or the item itself.
    """
    root = parse_html(html)
    items = list(root.find_all("div", "news-item")) or list(root.find_all("li", "news")) or list(root.find_all("article"))
    out = []
    for item in items:
        title = item.find("h3") or item.find("a") or item.find("h2")
        link = item.find("a")
        href = link.attrs.get("href", "") if link else ""
        if href and not href.startswith("http"):
            href = base + href
        date = item.find("span", "date") or item.find("time")
        body = item.find("div", "content") or item.find("article") or item.find("div", id_="content")
        if body is None and item.tag == "article":
            body = item
        out.append((title.text() if title else "", href, date.text() if date else "", body.text()[:longest] if body else ""))
    return out


def _base(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"


# --- frames ------------------------------------------------------------------------------------------------


def cell_rows(pages: DataFrame, key: str, table_id: str | None = None, cls: str | None = None) -> DataFrame:
    """(key, row number, cells) of the tables of every page."""

    def extract(batches):
        for batch in batches:
            rows = [
                (k, i, cells)
                for k, html in zip(batch[key], batch["html"])
                for i, cells in enumerate(table_cells(html, table_id, cls))
            ]
            yield pd.DataFrame(rows, columns=[key, "row", "cells"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "html").mapInPandas(extract, f"{key} {kind}, row int, cells array<string>")


def price_rows(pages: DataFrame, key: str = "symbol", limit: int | None = None) -> DataFrame:
    """Price table to bars: header skipped, unreadable rows dropped; `limit` keeps the first rows of each page if given."""
    cells = cell_rows(pages, key, table_id="table1").filter((F.col("row") >= 1) & (F.size("cells") >= 6))
    if limit is not None:
        cells = cells.filter(F.col("row") <= limit)
    c = lambda i: F.col("cells")[i]
    number = lambda i: F.replace(c(i), F.lit(","), F.lit("")).try_cast("double")
    out = cells.select(
        key,
        F.try_to_timestamp(c(0), F.lit("dd/MM/yyyy")).alias("timestamp"),
        number(1).alias("open"),
        number(2).alias("high"),
        number(3).alias("low"),
        number(4).alias("close"),
        number(4).alias("adj_close"),
        F.regexp_replace(c(5), "[,.]", "").try_cast("double").alias("volume"),
    )
    return out.dropna()


def news_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, item number, title, link, date text, body) of the news items of every page."""

    def extract(batches):
        for batch in batches:
            rows = [
                (k, i, *item)
                for k, url, html in zip(batch[key], batch["url"], batch["html"])
                for i, item in enumerate(news_items(html, _base(url)))
            ]
            yield pd.DataFrame(rows, columns=[key, "item", "title", "link", "date_text", "content"])

    kind = dict(pages.dtypes)[key]
    schema = f"{key} {kind}, item int, title string, link string, date_text string, content string"
    return pages.select(key, "url", "html").mapInPandas(extract, schema)


def label_values(pages: DataFrame, key: str = "symbol", cls: str | None = None) -> DataFrame:
    """(key, row, label, value text) of rows with at least two cells."""
    cells = cell_rows(pages, key, cls=cls).filter(F.size("cells") >= 2)
    return cells.select(key, "row", F.lower(F.col("cells")[0]).alias("label"), F.col("cells")[1].alias("value"))


# Label terms of the ratio page (first matching row wins).
RATIO_TERMS = {
    "market_cap": "vốn hóa", "pe_ratio": "P/E", "pb_ratio": "P/B", "ps_ratio": "P/S", "peg_ratio": "PEG",
    "ev_ebitda": "EV/EBITDA", "dividend_yield": "cổ tức", "roe": "ROE", "roa": "ROA",
    "gross_margin": "lợi nhuận gộp", "operating_margin": "hoạt động", "net_margin": "lợi nhuận ròng",
    "revenue_growth_yoy": "doanh thu", "profit_growth_yoy": "lợi nhuận", "debt_equity": "nợ/vốn",
    "current_ratio": "hiện tại", "quick_ratio": "nhanh", "eps": "EPS", "bvps": "BVPS",
}
# Label terms of the summary page (first matching entry names the row, last row wins).
SUMMARY_TERMS = [
    ("eps", ["eps"]), ("roe", ["roe"]), ("roa", ["roa"]), ("pe_ratio", ["p/e", "pe"]), ("pb_ratio", ["p/b", "pb"]),
    ("revenue", ["doanh thu", "revenue"]), ("net_profit", ["lợi nhuận", "profit"]),
]


def ratio_page_rows(pages: DataFrame, key: str = "symbol") -> DataFrame:
    """Ratio page to one row per key: the first row whose label holds the term gives the ratio."""
    rows = label_values(pages, key)

    def first(metric: str) -> Column:
        if metric not in RATIO_TERMS:
            return F.lit(None).cast("double").alias(metric)
        hit = F.contains(F.col("label"), F.lit(RATIO_TERMS[metric].lower()))
        return percent_number(F.min_by("value", F.when(hit, F.col("row")))).alias(metric)

    return rows.groupBy(key).agg(*[first(m) for m in FUNDAMENTAL_METRICS])


def summary_page_rows(pages: DataFrame, key: str = "symbol", cls: str | None = "financial-table") -> DataFrame:
    """Summary page to one row per key: each row belongs to the first fitting entry, the last row wins."""
    metric = F.lit(None).cast("string")
    for name, terms in reversed(SUMMARY_TERMS):
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(F.col("label"), F.lit(term))
        metric = F.when(hit, name).otherwise(metric)
    rows = label_values(pages, key, cls).withColumn("metric", metric).filter(F.col("metric").isNotNull())
    last = [
        local_number(F.max_by("value", F.when(F.col("metric") == name, F.col("row")))).alias(name) for name, _ in SUMMARY_TERMS
    ]
    return rows.groupBy(key).agg(*last)


def number_cells(pages: DataFrame, now: str | Column, key: str = "page_id") -> DataFrame:
    """(label, first, second, timestamp) of table rows, for the macro readers."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    cells = cell_rows(pages, key).filter(F.size("cells") >= 2)
    return cells.select(
        now.alias("timestamp"),
        F.col("cells")[0].alias("label"),
        local_number(F.col("cells")[1]).alias("first"),
        local_number(F.get("cells", F.lit(2))).alias("second"),
    )
