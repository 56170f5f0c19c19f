"""Queries that write tables, files or messages of the given data, or run a bounded stream over them, and read the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.catalog.base import query, scratch
from barlake.catalog.quality import _BAR, _SILVER
from barlake.plans import jobs
from barlake.sources.files import CSV_COLUMNS, export_csv, read_bar_files
from barlake.sources.tables import PARTITION, Lake, with_partition
from barlake.streaming import bars as sb
from barlake.streaming import ingest, sinks, sources, state

_LAST = "SELECT * FROM f3 QUALIFY row_number() OVER (PARTITION BY symbol, timestamp ORDER BY batch_seq DESC) = 1"
_OHLCV = "symbol timestamp:t open:4 high:4 low:4 close:4 volume:4"
#: Landings of a bounded stream, each a micro-batch of its own.
LANDINGS = 5


def _lake(t) -> Lake:
    return Lake(t.spark, scratch(t.spark, "lake"))


def _landed(t) -> Lake:
    """F3 in two batches of the same number by two writers; the second one corrects the first."""
    lake = _lake(t)
    for seq, writer in enumerate(("daily", "correction")):
        jobs.ingest(lake, t.f3.filter(F.col("batch_seq") == seq).drop("batch_seq"), 1, {"source": "events"}, writer)
    return lake


def _wait(running) -> None:
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


def _full(bars: DataFrame) -> DataFrame:
    """Bars with all columns that Bronze asks for."""
    return bars.withColumns({"adj_close": F.col("close"), "source": F.lit("events"), "ingestion_time": F.lit("2024-02-01").cast("timestamp")})


def _sliced(df: DataFrame, late: Column | None = None, landings: int = LANDINGS) -> DataFrame:
    """Rows with the number of the landing (`_landing`) that brings them: equal spans of time in order.

    Rows for which `late` holds come one landing after their own.
    """
    low, high = df.agg(F.unix_micros(F.min("timestamp").cast("timestamp")), F.unix_micros(F.max("timestamp").cast("timestamp"))).first()
    if low is None:
        return df.withColumn("_landing", F.lit(0))
    share = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.lit(low)) / F.lit(high - low + 1)
    own = F.floor(share * landings).cast("int")
    return df.withColumn("_landing", own if late is None else F.least(own + F.when(late, 1).otherwise(0), F.lit(landings - 1)))


def _land(t, sliced: DataFrame, start: Callable, again: bool = False, landings: int = LANDINGS) -> None:
    """Land the slices one by one; after each, `start(stream)` runs a query to its end, which is a restart from its checkpoint.

    With `again` each landing brings the rows of the one before once more.
    """
    folder, table = scratch(t.spark, "landing"), scratch(t.spark, "sliced")
    sliced.write.parquet(table)
    rows = t.spark.read.schema(sliced.schema).parquet(table)
    for k in range(landings):
        part = rows.filter(F.col("_landing").between(k - 1, k) if again else F.col("_landing") == k).drop("_landing")
        part.write.mode("append").parquet(folder)
        _wait(start(sources.bar_files(t.spark, folder, part.schema, sources.WHOLE_LANDING)))


def _streamed(t, sliced: DataFrame, build: Callable[[DataFrame], DataFrame], again: bool = False) -> DataFrame:
    """Rows that the streaming operator `build` appends to a table over all landings."""
    folder = scratch(t.spark, "stream")
    schema = None

    def start(stream: DataFrame):
        nonlocal schema
        out = build(stream)
        schema = out.schema
        writer = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        return writer.outputMode("append").trigger(availableNow=True).start()

    _land(t, sliced, start, again)
    return t.spark.read.schema(schema).parquet(f"{folder}/rows")


query("o_ingest", _BAR + " source", _LAST, "f3")(lambda t: _landed(t).read("bronze"))
query(
    "o_lineage",
    "symbol records_received:i writer",
    """SELECT symbol, CASE WHEN batch_seq = 0 THEN 'daily' ELSE 'correction' END AS writer, count(*) AS records_received
       FROM f3 GROUP BY ALL""",
    "f3",
)(lambda t: _landed(t).read_log("lineage").withColumn("writer", F.get_json_object("lineage", "$.writer")))


@query("o_slv_wr", _BAR, _SILVER, "f3")
def o_slv_wr(t):
    lake = _landed(t)
    jobs.refresh_silver(lake, "run")
    return lake.read("silver")


@query(
    "o_tblrw",
    "symbol timestamp:t close:4",
    "SELECT symbol, timestamp, CASE WHEN year(timestamp) >= 1996 THEN 2 * close ELSE close END AS close FROM f2",
    "f2",
)
def o_tblrw(t):
    """Partitions of later years are replaced, the others stay."""
    lake, rows = _lake(t), with_partition(t.f2)
    lake.append("bars", rows, PARTITION)
    lake.overwrite_partitions("bars", rows.filter("year >= 1996").withColumn("close", 2 * F.col("close")))
    return lake.read("bars")


@query("o_csvout", "symbol timestamp:t open:4 high:4 low:4 close:4 adj_close:4 volume:4", "SELECT *, close AS adj_close FROM f2", "f2")
def o_csvout(t):
    folder = scratch(t.spark, "csv")
    export_csv(t.f2.withColumn("adj_close", F.col("close")), folder)
    kinds = ", ".join(f"{c} {'timestamp' if c == 'timestamp' else 'double'}" for c in CSV_COLUMNS)
    return t.spark.read.option("header", True).schema(f"{kinds}, symbol string").csv(folder)


@query("o_csv", "symbol interval timestamp:t open:4 high:4 low:4 close:4 volume:4", "SELECT *, '1h' AS interval FROM f1", "f1")
def o_csv(t):
    """Bar files named by symbol and interval, all read at once."""
    folder = scratch(t.spark, "bar-files")
    rows = t.f1.select(F.concat("symbol", F.lit("_1h")).alias("file"), *[c if c != "adj_close" else F.col("close").alias(c) for c in CSV_COLUMNS])
    rows.write.option("header", True).partitionBy("file").csv(folder)
    return read_bar_files(t.spark, f"{folder}/*/*.csv")


@query(
    "o_macroing",
    "series timestamp:t value:4 source",
    """SELECT 'USD/VND' AS series, timestamp, usd_vnd AS value, 'fx' AS source FROM macro
       UNION ALL SELECT 'GOLD', timestamp, gold_usd_oz, 'gold' FROM macro
       UNION ALL SELECT 'WTI_OIL', timestamp, wti_usd_barrel, 'oil' FROM macro""",
    "macro",
)
def o_macroing(t):
    """Macro families in one long table; a repeated run replaces its rows."""
    lake = _lake(t)
    named = lambda name, column: (t.macro.select("timestamp", F.lit(name).alias("name"), column), "name", column)
    families = {"fx": named("USD/VND", "usd_vnd"), "gold": named("GOLD", "gold_usd_oz"), "oil": named("WTI_OIL", "wti_usd_barrel")}
    for _ in range(2):
        jobs.ingest_macro(lake, families, "run")
    return lake.read_log("macro")


query("o_kafka_out", _OHLCV, "SELECT * REPLACE (upper(symbol) AS symbol) FROM f2", "f2")(
    lambda t: sources.decode_bars(sinks.bar_messages(t.f2))
)
query(
    "o_topics",
    "topic key messages:i",
    """SELECT 'stock-ohlcv-raw' AS topic, symbol AS key, count(*) AS messages FROM f1 GROUP BY ALL
       UNION ALL SELECT 'stock-index', symbol, count(*) FROM f2 GROUP BY ALL""",
    "f1 f2",
)(lambda t: sinks.all_messages({"ohlcv": t.f1, "index": t.f2}).groupBy("topic", "key").agg(F.count("value").alias("messages")))



@query(
    "o_prefix",
    "symbol timestamp:t close:4",
    "SELECT symbol, timestamp, close FROM f1 WHERE symbol = (SELECT min(symbol) FROM f1) AND timestamp >= TIMESTAMP '2024-01-10'",
    "f1",
)
def o_prefix(t):
    """One symbol's folder of a table, read from a date on."""
    lake = _lake(t)
    lake.append("bars", with_partition(t.f1), PARTITION)
    return lake.read("bars", symbol=t.f1.agg(F.min("symbol")).first()[0], start="2024-01-10")


@query("o_files", "symbol year:i month:i empty:i", "SELECT DISTINCT symbol, year(timestamp) AS year, month(timestamp) AS month, 0 AS empty FROM f1", "f1")
def o_files(t):
    """File inventory of a layer by partition, with the number of empty files; a layer that is not there has none."""
    lake = _lake(t)
    lake.append("bars", with_partition(t.f1), PARTITION)
    of = lambda part: F.regexp_extract("path", f"{part}=([^/]+)", 1)
    files = lake.files("bars").unionByName(lake.files("missing"))
    return files.groupBy(of("symbol").alias("symbol"), of("year").alias("year"), of("month").alias("month")).agg(F.count_if(F.col("length") == 0).alias("empty"))


@query("o_ddl", "symbol timestamp:t close:4", "SELECT symbol, timestamp, close FROM f1", "f1")
def o_ddl(t):
    """A catalog table over a layer's folder, read by its name."""
    lake = _lake(t)
    lake.overwrite_partitions("bars", with_partition(_full(t.f1)))
    name = "bars_" + lake.root.rsplit("-", 1)[-1]
    lake.create_table(name, "bars")
    return t.spark.table(name)


@query(
    "o_run",
    "symbol status records_processed:i error_count:i",
    f"SELECT symbol, 'completed' AS status, count(*) AS records_processed, 0 AS error_count FROM ({_SILVER}) GROUP BY symbol",
    "f3",
)
def o_run(t):
    """Landing, Silver, gate and Gold of all symbols, and the run's record."""
    return jobs.run(_landed(t), "run-1")


# --- bounded streams ---------------------------------------------------------------------------------


@query("st_loop", _BAR, _SILVER, "f3")
def st_loop(t):
    """F3 in three landings; a correction comes with the landing of its bar or after it."""
    lake, checkpoint = _lake(t), scratch(t.spark, "checkpoint")
    sink = ingest.bar_ingest(lake)
    _land(t, _sliced(t.f3, F.col("batch_seq") == 1, 3), lambda stream: ingest.start(stream, sink, checkpoint, once=True), landings=3)
    return lake.read("silver")


query("st_idemp", _OHLCV, "SELECT * FROM f1", "f1")(lambda t: _streamed(t, _sliced(t.f1), lambda bars: sb.once(bars, "30 days"), again=True))
query(
    "st_tumble",
    _OHLCV,
    """SELECT * FROM (SELECT symbol, date_trunc('day', timestamp) AS timestamp, min_by(open, f1.timestamp) AS open, max(high) AS high,
       min(low) AS low, max_by(close, f1.timestamp) AS close, sum(volume) AS volume FROM f1 GROUP BY symbol, date_trunc('day', f1.timestamp))
       WHERE timestamp + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM f1)""",
    "f1",
)(lambda t: _streamed(t, _sliced(t.f1), lambda bars: sb.tumble(bars, "1 day", "1 hour")))
query(
    "st_late",
    _OHLCV,
    """SELECT d.* FROM (SELECT symbol, date_trunc('day', timestamp) AS timestamp, min_by(open, f1.timestamp) AS open, max(high) AS high,
       min(low) AS low, max_by(close, f1.timestamp) AS close, sum(volume) AS volume FROM f1 GROUP BY symbol, date_trunc('day', f1.timestamp)) d
       JOIN (SELECT symbol, max(timestamp) AS newest FROM f1 GROUP BY ALL) n ON n.symbol = d.symbol
       AND d.timestamp + INTERVAL 25 HOUR <= newest""",
    "f1",
)(lambda t: state.current_bars(_streamed(t, _sliced(t.f1, F.hour("timestamp") % 6 == 1), lambda bars: state.revised_bars(bars, "1 day", "1 hour"))))


@query(
    "st_alert",
    "type symbol price:4 condition timestamp:t",
    """SELECT 'alert' AS type, upper(f1.symbol) AS symbol, close AS price, 'above' AS condition, timestamp FROM f1
       JOIN (SELECT symbol, max(close) / 2 AS threshold FROM f1 GROUP BY ALL) r ON r.symbol = f1.symbol WHERE close > threshold""",
    "f1",
)
def st_alert(t):
    rules = t.f1.groupBy("symbol").agg((F.max("close") / 2).alias("threshold")).withColumn("condition", F.lit("above"))
    return _streamed(t, _sliced(t.f1), lambda bars: sb.stream_alerts(bars, rules))


query(
    "st_enrich",
    "symbol timestamp:t close:4 newest_volume:4",
    """SELECT symbol, timestamp, close, newest_volume FROM f1
       JOIN (SELECT symbol, max_by(volume, timestamp) AS newest_volume FROM f1 GROUP BY ALL) USING (symbol)""",
    "f1",
)(lambda t: _streamed(t, _sliced(t.f1), lambda bars: sb.enrich(bars, t.f1.select("symbol", "timestamp", F.col("volume").alias("newest_volume")))))
query("st_hwm", "symbol timestamp:t close:4", "SELECT * FROM f1", "f1")(
    lambda t: _streamed(t, _sliced(t.f1), state.newer_only, again=True)
)


@query(
    "st_fanin",
    "family symbol rows:i",
    """SELECT 'index' AS family, symbol, count(*) AS rows FROM f2 GROUP BY ALL
       UNION ALL SELECT 'ohlcv', symbol, count(*) FROM f1 GROUP BY ALL""",
    "f1 f2",
)
def st_fanin(t):
    """Two families with their own streams, checkpoints and tables, started together."""
    lake, folder = _lake(t), scratch(t.spark, "landing")
    families = {"ohlcv": _full(t.f1), "index": t.f2}
    for name, rows in families.items():
        rows.write.parquet(f"{folder}/{name}")
    streams = {name: sources.bar_files(t.spark, f"{folder}/{name}", rows.schema, sources.WHOLE_LANDING) for name, rows in families.items()}
    for running in ingest.start_families(lake, streams, scratch(t.spark, "checkpoints")).values():
        _wait(running)
    bars = lake.read("bronze").select("symbol").withColumn("family", F.lit("ohlcv"))
    index = lake.read_log("bronze_index").select("symbol").withColumn("family", F.lit("index"))
    return bars.unionByName(index).groupBy("family", "symbol").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "st_callback",
    "symbol bars:i newest:t",
    "SELECT symbol, count(*) AS bars, max(timestamp) AS newest FROM f1 GROUP BY ALL",
    "f1",
)
def st_callback(t):
    """A user hook gets every batch, although another hook fails each time."""
    lake, checkpoint = _lake(t), scratch(t.spark, "checkpoint")

    def broken(batch, batch_id):
        raise RuntimeError("a hook that always fails")

    hooks = [broken, lambda batch, batch_id: lake.append("seen", batch.select("symbol", "timestamp"))]
    sink = ingest.bar_ingest(lake, hooks)
    _land(t, _sliced(_full(t.f1), landings=2), lambda stream: ingest.start(stream, sink, checkpoint, once=True), landings=2)
    return lake.read("seen").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("timestamp").alias("newest"))


@query("st_poll", "symbol timestamp:t close:4", "SELECT symbol, timestamp, close FROM f1", "f1")
def st_poll(t):
    """A polling query that runs on while files land, stopped once it has taken all of them."""
    folder, out = scratch(t.spark, "landing"), scratch(t.spark, "stream")
    t.f1.write.parquet(folder)
    rows = sources.bar_files(t.spark, folder, t.f1.schema, sources.WHOLE_LANDING)
    sink = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
    running = ingest.start(rows, sink, f"{out}/checkpoint", every="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return t.spark.read.parquet(f"{out}/rows").select("symbol", "timestamp", "close")
