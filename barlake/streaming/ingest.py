"""Micro-batch ingest into a lake: every batch upserts Bronze and refreshes the touched Silver partitions."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barlake.operators.select import new_rows
from barlake.plans.jobs import refresh_silver
from barlake.sources.tables import Lake

log = logging.getLogger(__name__)

Hook = Callable[[DataFrame, int], None]


def trigger_options(once: bool = True, every: str | None = None) -> dict:
    """Bounded catch-up (`availableNow`), or polling every interval."""
    return {"processingTime": every} if every else ({"availableNow": True} if once else {"processingTime": "0 seconds"})


def writer_of(batch: DataFrame, name: str | None = None) -> str:
    """Who writes a micro-batch: the given name, else the query id, which belongs to the checkpoint."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return name or (f"stream-{query}" if query else "stream")


def bar_ingest(lake: Lake, hooks: list[Hook] | None = None, first_batch: int = 0, writer: str | None = None) -> Hook:
    """foreachBatch function: Bronze, Silver, then the user hooks, whose errors are logged only.

    Writer and batch id are the log partition, so a replayed batch overwrites what it wrote before, and neither
    another stream nor a new checkpoint does.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seq, who = first_batch + batch_id, writer_of(batch, writer)
        lake.append_bronze(batch, seq, {"source": "stream"}, who)
        refresh_silver(lake, f"{who}-{seq}", lake.touched(seq, who))
        for hook in hooks or []:
            try:
                hook(batch, batch_id)
            except Exception:
                log.exception("hook failed for batch %s", batch_id)

    return write


def table_ingest(lake: Lake, layer: str) -> Hook:
    """foreachBatch function for the other families: one log partition per batch."""
    return lambda batch, batch_id: lake.log(layer, batch, f"{writer_of(batch)}-{batch_id}")


def only_new(lake: Lake, sink: Hook, table: str = "high_water") -> Hook:
    """foreachBatch function that passes on rows newer than the stored last time of their symbol.

    The state is one row per symbol and batch; all batches but the current one count, so a replay sees
    the same state and a new checkpoint goes on from the old one's.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"{writer_of(batch)}-{batch_id}"
        rows = new_rows(batch, lake.read_log(table).filter(F.col("run_id") != own)) if lake.exists(table) else batch
        sink(rows, batch_id)
        lake.log(table, rows.groupBy("symbol").agg(F.max("timestamp").alias("timestamp")), own)

    return write


def start(stream: DataFrame, sink: Hook, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**trigger_options(**trigger)).start()


def start_families(
    lake: Lake, families: dict[str, DataFrame], checkpoints: str, bars: str = "ohlcv", cadence: dict[str, dict] | None = None
) -> dict[str, StreamingQuery]:
    """One query per family with its own checkpoint and cadence; bars go through Bronze and Silver."""
    out = {}
    for family, stream in families.items():
        sink = bar_ingest(lake) if family == bars else table_ingest(lake, f"bronze_{family}")
        out[family] = start(stream, sink, f"{checkpoints}/{family}", family, **(cadence or {}).get(family, {}))
    return out
