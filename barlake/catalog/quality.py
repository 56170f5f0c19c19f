"""Checks, filters, layers and table versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.catalog.base import query
from barlake.functions.calendar import calendar_parts
from barlake.operators import quality as q
from barlake.operators import select as s
from barlake.plans.series import tail_n
from barlake.sources import tables

_BAR = "symbol timestamp:t open:4 high:4 low:4 close:4 adj_close:4 volume:4"
_OK = "coalesce(high >= open AND high >= close AND low <= open AND low <= close AND high >= low, false)"
_MISS = "(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR timestamp IS NULL)"
_NEG = "coalesce(volume < 0, false)"
_GOOD = f"(NOT {_MISS} AND {_OK} AND NOT {_NEG})"
_DUP = "(row_number() OVER (PARTITION BY symbol, timestamp ORDER BY batch_seq DESC) > 1)"
_SILVER = f"SELECT * FROM f3 WHERE {_GOOD} QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER BY batch_seq DESC) = 1"


def _text_bars(t):
    """F3 as text, as a raw landing file would hold it; every 50th open does not parse."""
    bad = F.pmod(F.unix_seconds("timestamp") / 3600, F.lit(50)) == 0
    raw = t.f3.withColumns({c: F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")})
    return raw.withColumns({"symbol": F.lower("symbol"), "open": F.when(bad, "n/a").otherwise(F.col("open"))})


@query(
    "p_schema",
    _BAR + " source ingestion_time:t",
    "SELECT * REPLACE (CASE WHEN CAST(epoch(timestamp) AS BIGINT) // 3600 % 50 = 0 THEN NULL ELSE open END AS open) FROM f3",
    "f3",
)
def p_schema(t):
    return q.conform(_text_bars(t))


query("p_ohlc", _BAR + " batch_seq:i", f"SELECT * FROM f3 WHERE NOT {_OK}", "f3")(lambda t: t.f3.filter(~q.valid_prices()))
query("p_vol", _BAR + " batch_seq:i", f"SELECT * FROM f3 WHERE {_NEG}", "f3")(lambda t: t.f3.filter(q.negative_volume()))
query("p_miss", _BAR + " batch_seq:i", f"SELECT * FROM f3 WHERE {_MISS}", "f3")(lambda t: t.f3.filter(q.missing_any()))


@query(
    "p_quar",
    _BAR + " batch_seq:i error_reason",
    f"""SELECT *, CASE WHEN {_MISS} THEN 'missing;' ELSE '' END || CASE WHEN NOT {_OK} THEN 'invalid_ohlc;' ELSE '' END ||
        CASE WHEN {_NEG} THEN 'invalid_volume;' ELSE '' END || CASE WHEN dup THEN 'duplicate;' ELSE '' END AS error_reason
        FROM (SELECT *, {_DUP} AS dup FROM f3) WHERE NOT {_GOOD} OR dup""",
    "f3",
)
def p_quar(t):
    return q.quarantine(t.f3)


query("o_brz_slv", _BAR, _SILVER, "f3")(lambda t: q.silver(q.conform(t.f3, keep=["batch_seq"])))

query(
    "w_dedup",
    _BAR + " batch_seq:i",
    "SELECT * FROM f3 QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER BY batch_seq DESC) = 1",
    "f3",
)(lambda t: q.keep_last(t.f3))

query(
    "a_dup",
    "symbol duplicate_count:i",
    "SELECT symbol, sum(n - 1) AS duplicate_count FROM (SELECT symbol, timestamp, count(*) AS n FROM f3 GROUP BY ALL) GROUP BY ALL",
    "f3",
)(lambda t: q.duplicate_count(t.f3))


@query(
    "a_qual",
    "symbol source_count:i record_count:i duplicate_count:i missing_count:i invalid_ohlc_count:i invalid_volume_count:i "
    "error_count:i min_timestamp:t max_timestamp:t quality_status",
    f"""SELECT *, CASE WHEN record_count = 0 THEN 'failed' WHEN invalid_ohlc_count = 0 THEN 'passed' ELSE 'warning' END
        AS quality_status FROM (SELECT symbol, count(*) AS source_count, count(DISTINCT CASE WHEN good THEN timestamp END)
        AS record_count, count(*) FILTER (dup) AS duplicate_count, count(*) FILTER ({_MISS}) AS missing_count,
        count(*) FILTER (NOT {_OK}) AS invalid_ohlc_count, count(*) FILTER ({_NEG}) AS invalid_volume_count,
        count(*) FILTER (dup OR NOT good) AS error_count, min(timestamp) FILTER (good) AS min_timestamp,
        max(timestamp) FILTER (good) AS max_timestamp
        FROM (SELECT *, {_DUP} AS dup, {_GOOD} AS good FROM f3) GROUP BY ALL)""",
    "f3",
)
def a_qual(t):
    return q.silver_quality(t.f3)


_REPORT = (
    "symbol row_count:i duplicate_count:i missing_count:i invalid_ohlc_count:i invalid_volume_count:i "
    "min_timestamp:t max_timestamp:t quality_status"
)


@query(
    "a_gate",
    _REPORT,
    f"""SELECT *, CASE WHEN invalid_ohlc_count > 0 OR row_count = 0 THEN 'failed' ELSE 'passed' END AS quality_status
        FROM (SELECT symbol, count(*) AS row_count, count(*) - count(DISTINCT timestamp) AS duplicate_count,
        count(*) FILTER ({_MISS}) AS missing_count, count(*) FILTER (NOT {_OK}) AS invalid_ohlc_count,
        count(*) FILTER ({_NEG}) AS invalid_volume_count, min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp
        FROM ({_SILVER}) GROUP BY ALL)""",
    "f3",
)
def a_gate(t):
    clean = q.silver(t.f3)
    report = q.quality_report(clean, expected=t.f3)
    return report.join(q.passed_only(clean, report).select("symbol").distinct(), "symbol", "left_semi")


query("p_eq", _BAR, "SELECT *, close AS adj_close FROM f1 WHERE symbol = 'CLICK'", "f1")(
    lambda t: s.of_symbol(t.f1.withColumn("adj_close", F.col("close")), "click")
)
query(
    "p_range",
    "symbol timestamp:t close:4",
    "SELECT * FROM f1 WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00'",
    "f1",
)(lambda t: s.in_range(t.f1, "2024-01-10", "2024-01-20 12:00:00"))
query(
    "p_lookback",
    "symbol timestamp:t close:4",
    "SELECT * FROM f1 WHERE timestamp >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY",
    "f1",
)(lambda t: s.lookback(t.f1, "2024-01-30", days=7))
query("p_notnull", _BAR, "SELECT * FROM f3 WHERE open IS NOT NULL AND close IS NOT NULL", "f3")(
    lambda t: t.f3.dropna(subset=["open", "close"])
)
query(
    "p_newrows",
    "symbol timestamp:t close:4",
    """SELECT * FROM f1 b LEFT JOIN (SELECT symbol, max(timestamp) AS seen FROM f1 WHERE timestamp < TIMESTAMP '2024-01-20'
       AND symbol <> 'VIEW' GROUP BY ALL) h USING (symbol) WHERE seen IS NULL OR timestamp > seen""",
    "f1",
)(lambda t: s.new_rows(t.f1, t.f1.filter("timestamp < timestamp'2024-01-20' AND symbol <> 'VIEW'")))
query("p_symvalid", "symbol ok", "SELECT DISTINCT symbol, regexp_matches(symbol, '^[A-Za-z]{1,5}$') AS ok FROM f1", "f1")(
    lambda t: t.f1.select("symbol", s.valid_symbol().alias("ok")).distinct()
)


def _layers(t):
    """Gold holds one symbol, Silver two, Bronze all."""
    return t.f1.filter("symbol = 'CLICK'"), t.f1.filter("symbol IN ('CLICK', 'ERROR')"), t.f1


query(
    "p_layer",
    "symbol timestamp:t close:4 layer interval",
    """SELECT *, CASE symbol WHEN 'CLICK' THEN 'gold' WHEN 'ERROR' THEN 'silver' ELSE 'bronze' END AS layer,
       '1h' AS interval FROM f1""",
    "f1",
)(lambda t: s.history(*_layers(t), interval="1h"))

_LATEST = """SELECT *, (close - prev_close) / prev_close AS change_pct FROM (SELECT *, lag(close) OVER
    (PARTITION BY symbol ORDER BY timestamp) AS prev_close FROM f1)
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1"""
query("w_latest", "symbol timestamp:t open:4 high:4 low:4 close:4 volume:4 prev_close:4 change_pct:8", _LATEST, "f1")(
    lambda t: s.latest_change(t.f1)
)
query(
    "w_tail",
    "symbol timestamp:t close:4",
    "SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) <= 400",
    "f1",
)(lambda t: tail_n(t.f1, 400))
query(
    "w_recent",
    "symbol timestamp:t close:4",
    """SELECT * FROM f1 WHERE timestamp >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) <= 5""",
    "f1",
)(lambda t: s.recent(t.f1, "2024-01-30", 14, 5))

query(
    "a_count",
    "layer symbol record_count:i",
    f"""SELECT 'bronze' AS layer, symbol, count(*) AS record_count FROM f3 GROUP BY ALL
        UNION ALL SELECT 'silver', symbol, count(*) FROM ({_SILVER}) GROUP BY ALL""",
    "f3",
)(lambda t: tables.layer_counts({"bronze": t.f3, "silver": q.silver(t.f3)}))
query(
    "a_syms",
    "symbols:i first_date:t last_date:t",
    """SELECT count(DISTINCT coalesce(upper(symbol), 'MARKET')) AS symbols, min(published_date) AS first_date,
       max(published_date) AS last_date FROM news""",
    "news",
)(
    lambda t: t.news.agg(
        F.count_distinct(F.coalesce(F.upper("symbol"), F.lit("MARKET"))).alias("symbols"),
        F.min("published_date").alias("first_date"),
        F.max("published_date").alias("last_date"),
    )
)
query(
    "a_ingsum",
    "source rows:i",
    "SELECT source, count(*) AS rows FROM (SELECT source FROM f3 UNION ALL SELECT source FROM news) GROUP BY ALL",
    "f3 news",
)(lambda t: tables.ingest_summary([t.f3, t.news]))
query(
    "u_union",
    "symbol timestamp:t close:4 batch_seq:i",
    "SELECT symbol, timestamp, close, CAST(NULL AS INTEGER) AS batch_seq FROM f1 UNION ALL SELECT symbol, timestamp, close, batch_seq FROM f3",
    "f1 f3",
)(lambda t: t.f1.unionByName(t.f3, allowMissingColumns=True))
query("u_distinct", "symbol timestamp:t", "SELECT DISTINCT symbol, timestamp FROM f3", "f3")(
    lambda t: t.f3.select("symbol", "timestamp").distinct()
)
query("l_sort", "symbol timestamp:t close:4", "SELECT * FROM f1 ORDER BY symbol, timestamp", "f1")(
    lambda t: t.f1.orderBy("symbol", "timestamp")
)
query(
    "l_limit",
    "event_id:i ts:t value:4",
    "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 30",
)(lambda t: t.table("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(30))

# --- tables and versions: an arrival log is F3 with one batch per batch_seq -----------------------

_LAST_OF = "QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER BY ingestion_time DESC, batch_seq DESC) = 1"
query("o_brz", _BAR + " source", f"SELECT * FROM f3 {_LAST_OF}", "f3")(
    lambda t: tables.upsert(t.f3.filter("batch_seq = 0"), t.f3.filter("batch_seq = 1"))
)
query("o_brz_rd", _BAR, f"SELECT * FROM f3 WHERE symbol = 'CLICK' {_LAST_OF}", "f3")(
    lambda t: tables.read_bars(tables.upsert(t.f3.filter("batch_seq = 0"), t.f3.filter("batch_seq = 1")), "click")
)
query("o_slv_rd", _BAR, _SILVER.replace("WHERE", "WHERE symbol = 'VIEW' AND"), "f3")(
    lambda t: tables.read_bars(q.silver(t.f3), "view")
)
query(
    "o_part",
    "symbol timestamp:t close:4 year:i month:i path",
    """SELECT *, year(timestamp) AS year, month(timestamp) AS month, 'symbol=' || symbol || '/year=' || year(timestamp) ||
       '/month=' || month(timestamp) AS path FROM f2""",
    "f2",
)(lambda t: tables.with_partition_path(t.f2))
query(
    "o_asof",
    _BAR,
    f"SELECT * FROM f3 WHERE ingestion_time <= TIMESTAMP '2024-02-01 00:30:00' {_LAST_OF}",
    "f3",
)(lambda t: tables.as_of_time(t.f3, "2024-02-01 00:30:00"))
_SNAP = "SELECT batch_seq AS snapshot_id, max(ingestion_time) AS committed_at, count(*) AS rows FROM f3 GROUP BY ALL"
query(
    "o_snap",
    "snapshot_id:i committed_at:t rows:i parent_id:i is_current",
    f"""SELECT *, lag(snapshot_id) OVER (ORDER BY committed_at, snapshot_id) AS parent_id,
        snapshot_id = (SELECT max(batch_seq) FROM f3) AS is_current FROM ({_SNAP})""",
    "f3",
)(lambda t: tables.snapshots(t.f3))
query(
    "o_expire",
    "snapshot_id:i committed_at:t",
    f"SELECT * FROM ({_SNAP}) WHERE committed_at < TIMESTAMP '2024-02-20' - INTERVAL 7 DAY AND snapshot_id <> 1",
    "f3",
)(lambda t: tables.expired_snapshots(t.f3, "2024-02-20", 7))


def _runs(t):
    """Orders as run records of their customer's symbol."""
    return t.table("orders").select(
        F.concat(F.lit("C"), F.col("o_custkey") % 50).alias("symbol"),
        F.col("o_orderstatus").alias("model_name"),
        F.col("o_orderkey").alias("run_id"),
        F.struct(F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("id")).alias("created_at"),
        F.col("o_totalprice").alias("total_return"),
    )


query(
    "o_runlog",
    "symbol run_id:i total_return:2",
    """SELECT 'C' || (o_custkey % 50) AS symbol, o_orderkey AS run_id, o_totalprice AS total_return FROM orders
       WHERE o_custkey % 50 = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30""",
)(lambda t: s.newest_runs(_runs(t), 30, "C7"))
query(
    "a_cmpmodel",
    "symbol model_name run_id:i total_return:2",
    """SELECT 'C' || (o_custkey % 50) AS symbol, o_orderstatus AS model_name, o_orderkey AS run_id,
       o_totalprice AS total_return FROM orders QUALIFY row_number() OVER (PARTITION BY 1, o_custkey % 50, o_orderstatus
       ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)(lambda t: s.latest_per_model(_runs(t)))
query(
    "o_prefer",
    "symbol timestamp:t close:4 origin",
    """SELECT symbol, timestamp, close, 'first' AS origin FROM f1 WHERE symbol IN ('CLICK', 'VIEW')
       UNION ALL SELECT symbol, timestamp, close, 'second' FROM f1 WHERE symbol NOT IN ('CLICK', 'VIEW')""",
    "f1",
)(lambda t: s.first_source([("first", t.f1.filter("symbol IN ('CLICK', 'VIEW')")), ("second", t.f1)], "origin"))
query(
    "f_cal",
    "symbol timestamp:t year:i month:i quarter:i year_month date",
    """SELECT *, year(timestamp) AS year, month(timestamp) AS month, quarter(timestamp) AS quarter,
       strftime(timestamp, '%Y-%m') AS year_month, CAST(timestamp AS DATE) AS date FROM f2""",
    "f2",
)(lambda t: t.f2.withColumns(calendar_parts("timestamp")))
query(
    "f_epoch",
    "event_id:i seconds:i back:t iso",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000)
       AS back, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events""",
)(
    lambda t: t.table("events").select(
        "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"),
        F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("back"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )
)
