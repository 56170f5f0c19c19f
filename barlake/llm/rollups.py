"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A change row says what happened to a document's count: `insert` (new count), `delete` (old count) or `revise` (old
and new). A batch of changes becomes one small table of signed sums in its own folder of the store, and counts once
its commit marker is there. Committing a batch again does nothing; a batch that failed half-way is written anew.
Totals are the sums over committed batches, so batches may arrive in any order and deletes need no look-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import tokens
from barlake.llm.common import columns
from barlake.llm.words import slices

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of every row under each vocabulary file; null text has no tokens."""
    encoders = {v: tokens.byte_ids if path.endswith(".tiktoken") else tokens.word_ids for v, path in vocabularies.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            for version, path in vocabularies.items():
                sizes = [np.diff(encoders[version](texts.slice(a, b - a), path)[1]) for a, b in slices(texts, 6_000_000)]
                sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([version] * len(sizes), pa.string()), pa.array(sizes, pa.int64())],
                    ["doc_id", "source", "lang", "tokenizer", "n_tokens"],
                )

    rows_in = columns(docs, "doc_id", "source", "lang", "text")
    return rows_in.mapInArrow(rows, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per key of rows with op, old_tokens and new_tokens; nulls in keys are a group of their own."""
    old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
    size = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old)
    checked = lambda c: F.when(docs.isNull(), F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null"))))).otherwise(c)
    return changes.groupBy(*KEYS).agg(F.sum(checked(docs)).cast("long").alias("n_docs"), F.sum(checked(size)).cast("long").alias("n_tokens"))


def _marked(spark: SparkSession, store: str) -> list[str]:
    """Folders of committed batches, through the file system that Spark would use for the store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    folders = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(str(p) for p in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def committed(spark: SparkSession, store: str) -> list[str]:
    return [p.rsplit("/batch-", 1)[1] for p in _marked(spark, store)]


def commit(changes: DataFrame, store: str, batch_id: str) -> bool:
    """Add a batch to the store; False if it was there already. The marker is the committer's `_SUCCESS`."""
    spark = changes.sparkSession
    if str(batch_id) in committed(spark, store):
        return False
    signed = deltas(changes)

    signed.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{store}/batch-{batch_id}")
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Additive totals over all committed batches; keys whose documents are all gone are left out."""
    paths = _marked(spark, store)
    if not paths:
        return spark.createDataFrame([], TOTALS)
    sums = spark.read.schema(TOTALS).parquet(*paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")
