"""Bar, news, order-book and macro inputs shaped from the driver tables.

Every view exists twice: as DataFrame code and as the SQL text used by the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Driver tables of one scale factor and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        """One event = one tick of the symbol named by its type."""
        return self.table("events").select(
            F.upper("event_type").alias("symbol"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.col("event_id").alias("tick_id"),
            F.col("value").alias("price"),
        )

    @cached_property
    def f1(self) -> DataFrame:
        """Hourly bars from events."""
        order = F.struct("timestamp", "tick_id")
        return (
            self.ticks.groupBy("symbol", F.date_trunc("hour", "timestamp").alias("bar_ts"))
            .agg(
                F.min_by("price", order).alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", order).alias("close"),
                F.count(F.lit(1)).cast("double").alias("volume"),
            )
            .withColumnRenamed("bar_ts", "timestamp")
        )

    @cached_property
    def f2(self) -> DataFrame:
        """Daily bars from orders."""
        day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("timestamp")
        return self.table("orders").groupBy(F.col("o_orderpriority").alias("symbol"), day).agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )

    @cached_property
    def f3(self) -> DataFrame:
        """F1 with nulls, broken highs, negative volumes and repeated keys."""
        from barlake.plans.series import POS, number_rows

        b = number_rows(self.f1).withColumn("rn", F.col(POS) + 1)
        every = lambda n: F.col("rn") % n == 0
        dirty = b.select(
            "symbol",
            "timestamp",
            F.when(~every(41), F.col("open")).alias("open"),
            F.when(every(37), F.col("low") - 1).otherwise(F.col("high")).alias("high"),
            "low",
            "close",
            F.when(every(53), -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
            "rn",
        )
        first = dirty.withColumn("batch_seq", F.lit(0).cast("long")).drop("rn")
        again = b.filter(every(29)).select(
            "symbol", "timestamp", "open", "high", "low", "close", "volume", F.lit(1).cast("long").alias("batch_seq")
        )
        return (
            first.unionByName(again)
            .withColumn("adj_close", F.col("close"))
            .withColumn("source", F.lit("events"))
            .withColumn("ingestion_time", F.timestamp_seconds(F.lit(1706745600) + F.col("batch_seq") * 3600))
        )

    @cached_property
    def news(self) -> DataFrame:
        """Articles from documents: every tenth has no symbol."""
        d = self.table("documents")
        return d.select(
            F.col("doc_id"),
            F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("symbol"),
            F.substring("text", 1, 80).alias("title"),
            F.col("text").alias("content"),
            F.concat(F.lit("doc://"), F.col("doc_id")).alias("url"),
            F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 30) * 86400).alias("published_date"),
            F.lit("documents").alias("source"),
        )

    @cached_property
    def levels(self) -> DataFrame:
        """Order-book levels from lineitem (level numbers are computed by the operator)."""
        return self.table("lineitem").select(
            F.concat(F.lit("P"), F.col("l_partkey") % 20).alias("symbol"),
            F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
            F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid").alias("side"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").cast("long").alias("volume"),
            F.lit(1).cast("long").alias("orders"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_returnflag").alias("symbol"),
            F.col("l_shipdate").cast("timestamp").alias("timestamp"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").cast("long").alias("volume"),
            F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        )

    @cached_property
    def macro(self) -> DataFrame:
        """Monthly macro rows, published on the first day of the next month."""
        status = {"O": "usd_vnd", "F": "gold_usd_oz", "P": "wti_usd_barrel"}
        month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
        means = [
            F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(name) for s, name in status.items()
        ]
        return (
            self.table("orders")
            .groupBy((month + F.expr("interval 1 month")).alias("timestamp"))
            .agg(*means)
            .select("timestamp", *status.values())
        )

    @cached_property
    def index(self) -> DataFrame:
        """Mean close of F2 over symbols per time, with its returns."""
        from barlake.plans.series import series

        mean = self.f2.groupBy("timestamp").agg(F.avg("close").alias("close")).withColumn("symbol", F.lit("INDEX"))
        b = series(mean, before=1)
        return b.add({"returns": F.try_divide("close", b.lag("close")) - 1}).rows().drop("symbol")

    @cached_property
    def indices(self) -> DataFrame:
        """F2 under five index names (same bars)."""
        return self.f2

    @cached_property
    def sector_of(self) -> DataFrame:
        """Symbol to sector, for the priorities present in F2."""
        return self.f2.select("symbol").distinct().withColumn(
            "sector", F.when(F.col("symbol") < "3", "FIN").otherwise("IND")
        )

    @cached_property
    def fundamentals(self) -> DataFrame:
        """One record per supplier."""
        first = self.table("lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("period"))
        s = self.table("supplier")
        return s.join(first, s.s_suppkey == first.l_suppkey, "left").select(
            F.col("s_name").alias("symbol"),
            (F.col("s_acctbal") / 100).alias("pe_ratio"),
            F.col("period").cast("timestamp").alias("period"),
        )


# --- the same views as SQL ---------------------------------------------------------------------

SQL = {
    "ticks": "SELECT upper(event_type) AS symbol, ts AS timestamp, event_id AS tick_id, value AS price FROM events",
    "f1": """SELECT upper(event_type) AS symbol, date_trunc('hour', ts) AS timestamp,
        min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        max_by(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events GROUP BY ALL""",
    "f2": """SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS timestamp,
        min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
        max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM orders GROUP BY ALL""",
    "f3b": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn FROM f1",
    "f3": """SELECT symbol, timestamp, CASE WHEN rn % 41 = 0 THEN NULL ELSE open END AS open,
        CASE WHEN rn % 37 = 0 THEN low - 1 ELSE high END AS high, low, close,
        CASE WHEN rn % 53 = 0 THEN -volume ELSE volume END AS volume, 0 AS batch_seq,
        close AS adj_close, 'events' AS source, TIMESTAMP '2024-02-01' AS ingestion_time FROM f3b
        UNION ALL SELECT symbol, timestamp, open, high, low, close, volume, 1, close, 'events',
        TIMESTAMP '2024-02-01 01:00:00' FROM f3b WHERE rn % 29 = 0""",
    "news": """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN source END AS symbol, substring(text, 1, 80) AS title,
        text AS content, 'doc://' || doc_id AS url,
        TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INTEGER)) AS published_date, 'documents' AS source
        FROM documents""",
    "levels": """SELECT 'P' || (l_partkey % 20) AS symbol, date_trunc('month', l_shipdate) AS timestamp,
        CASE WHEN l_linestatus = 'O' THEN 'ask' ELSE 'bid' END AS side, l_extendedprice / l_quantity AS price,
        CAST(l_quantity AS BIGINT) AS volume, CAST(1 AS BIGINT) AS orders FROM lineitem""",
    "trades": """SELECT l_returnflag AS symbol, l_shipdate AS timestamp, l_extendedprice / l_quantity AS price,
        CAST(l_quantity AS BIGINT) AS volume, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side
        FROM lineitem""",
    "macro": """SELECT date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS timestamp,
        avg(o_totalprice) FILTER (o_orderstatus = 'O') AS usd_vnd,
        avg(o_totalprice) FILTER (o_orderstatus = 'F') AS gold_usd_oz,
        avg(o_totalprice) FILTER (o_orderstatus = 'P') AS wti_usd_barrel FROM orders GROUP BY ALL""",
    "idx0": "SELECT timestamp, avg(close) AS close FROM f2 GROUP BY ALL",
    "idx": "SELECT timestamp, close, close / lag(close) OVER (ORDER BY timestamp) - 1 AS returns FROM idx0",
    "sector_of": "SELECT DISTINCT symbol, CASE WHEN symbol < '3' THEN 'FIN' ELSE 'IND' END AS sector FROM f2",
    "fundamentals": """SELECT s_name AS symbol, s_acctbal / 100 AS pe_ratio, period FROM supplier LEFT JOIN
        (SELECT l_suppkey, min(l_shipdate) AS period FROM lineitem GROUP BY ALL) ON s_suppkey = l_suppkey""",
}
NEEDS = {"f3b": ["f1"], "f3": ["f1", "f3b"], "idx0": ["f2"], "idx": ["f2", "idx0"], "sector_of": ["f2"]}


def with_views(views: str) -> str:
    """`WITH [RECURSIVE] …` clause that defines the named views and what they need."""
    names: list[str] = []
    for view in views.split():
        for name in [*NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    return ", ".join(f"{name} AS ({SQL[name]})" for name in names)
