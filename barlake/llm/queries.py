"""Named queries of this package: each runs one operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import alignment, decontaminate, html, jaccard_join, language, line_dedup, negatives, packing, quality, rollups, secrets, token_files, topk
from barlake.llm.common import read, shared_folder, stored
from barlake.llm.tokens import vocabulary


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = quality.judged(read(spark, sf_dir, "documents"))
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(docs.where(~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, then every count is revised (an end id is counted too), then toxic ones are deleted.

    The revision is committed twice, as after a lost reply of the first commit.
    """
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    versions = {name.split(".")[0]: vocabulary(name) for name in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json")}
    counts = stored(rollups.count_tokens(docs, versions), "counts")
    keys = ["source", "lang", "tokenizer"]
    n = F.col("n_tokens")
    change = lambda rows, op, old, new: rows.select(*keys, F.lit(op).alias("op"), old.cast("long").alias("old_tokens"), new.cast("long").alias("new_tokens"))
    store = shared_folder(spark, "token-totals")
    rollups.commit(change(counts, "insert", F.lit(None), n), store, "1-load")
    for _ in range(2):
        rollups.commit(change(counts, "revise", n, n + 1), store, "2-end-ids")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    rollups.commit(change(counts.join(toxic, "doc_id", "left_semi"), "delete", n + 1, F.lit(None)), store, "3-toxic")
    return rollups.totals(spark, store)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_secrets, op3_main_text, op4_contamination, op5_quality, op6_line_dedup, op7_language, op8_token_rollup, op9_token_files, op10_packing,
        op11_hard_negatives, op12_top_k, op13_alignment,
    )
}
ORACLES = {"op6_line_dedup": line_dedup.SQL, "op11_hard_negatives": negatives.SQL, "op12_top_k": topk.SQL}
