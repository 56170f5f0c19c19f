"""Streaming sources: bar messages from a broker, or landing files with the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.schemas import BAR, BAR_COLUMNS, PRICE_COLUMNS

# Topic names per record family.
TOPICS = {
    "ohlcv": "stock-ohlcv-raw",
    "enriched": "stock-ohlcv-enriched",
    "alerts": "stock-alerts",
    "sentiment": "stock-sentiment",
    "fundamental": "stock-fundamental",
    "orderbook": "stock-orderbook",
    "index": "stock-index",
}


def broker_options(servers: str, topics: list[str] | str, starting: str = "latest", per_batch: int | None = None) -> dict[str, str]:
    """Reader options; offsets live in the query checkpoint, not with the broker."""
    topics = [topics] if isinstance(topics, str) else topics
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": starting}
    if per_batch:
        options["maxOffsetsPerTrigger"] = str(per_batch)
    return options


def broker_stream(spark: SparkSession, servers: str, topics: list[str] | str, **kw) -> DataFrame:
    return spark.readStream.format("kafka").options(**broker_options(servers, topics, **kw)).load()


def message_files(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """Landing folder of text files, one JSON message per line, with the broker's `value` column."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", per_batch).text(path)


def bar_files(spark: SparkSession, path: str, schema: T.StructType = BAR, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


#: Files per batch where a batch is all that has landed so far.
WHOLE_LANDING = 2**31 - 1


# Every field is read as text first, so that one bad number does not lose the message.
_MESSAGE = T.StructType(
    [T.StructField(c, T.StringType()) for c in BAR_COLUMNS]
    + [T.StructField("bars", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in BAR_COLUMNS])))]
)


def decode_bars(messages: DataFrame) -> DataFrame:
    """JSON messages (one bar, or an envelope of bars) to typed bars; other text gives no rows."""
    m = F.from_json(F.col("value").cast("string"), _MESSAGE)
    bars = F.when(m["bars"].isNotNull(), m["bars"]).otherwise(F.array(F.struct(*[m[c].alias(c) for c in BAR_COLUMNS])))
    rows = messages.select(m["symbol"].alias("outer"), F.explode(bars).alias("b")).select("outer", "b.*")
    out = []
    for c in BAR_COLUMNS:
        col = F.col(c)
        if c in PRICE_COLUMNS:
            col = col.try_cast("double")
        elif c in ("timestamp", "ingestion_time"):
            col = col.try_cast("timestamp")
        elif c == "symbol":
            col = F.upper(F.coalesce("symbol", "outer"))
        out.append(col.alias(c))
    return rows.select(*out).filter(F.col("symbol").isNotNull() & F.col("timestamp").isNotNull())


def undecodable(messages: DataFrame) -> DataFrame:
    """Messages that are no JSON objects with a symbol, for the quarantine."""
    m = F.from_json(F.col("value").cast("string"), _MESSAGE)
    return messages.filter(m["symbol"].isNull())
