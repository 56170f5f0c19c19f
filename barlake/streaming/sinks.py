"""Messages for a broker sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.streaming.sources import TOPICS

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def bar_messages(bars: DataFrame, family: str = "ohlcv") -> DataFrame:
    """One JSON message per row, keyed by symbol, with the topic of its family."""
    value = F.to_json(F.struct(*bars.columns), {"timestampFormat": _ISO})
    return bars.select(F.col("symbol").cast("string").alias("key"), value.alias("value"), F.lit(TOPICS[family]).alias("topic"))


def all_messages(families: dict[str, DataFrame]) -> DataFrame:
    """Messages of several families in one frame; the `topic` column routes them."""
    out = None
    for family, df in families.items():
        part = bar_messages(df, family)
        out = part if out is None else out.unionByName(part)
    return out


def write_broker(messages: DataFrame, servers: str) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.compression.type", "gzip").save()


def stream_to_broker(messages: DataFrame, servers: str, checkpoint: str):
    return (
        messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint).start()
    )
