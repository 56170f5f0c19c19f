"""Corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents:

    quality           documents that the rules reject go; short or repetitive ones among them
    line_dedup        later copies of repeated three-line windows are cut; a document left without a word goes
    near_duplicates   the document with the smallest doc_id of each group stays
    decontamination   documents that hold a twentieth or more of benchmark words go
    packing           pieces of documents in sequences of 2048 tokens

Null texts have no words and go in the first stage. Rows without doc_id pass the first four stages as documents of
their own. Further columns of the input are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm import decontaminate, jaccard_join, packing, quality
from barlake.llm import line_dedup as lines
from barlake.llm.common import read, stored
from barlake.llm.tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.line_dedup(docs)
    return cleaned.where(f"n_removed = 0 or text rlike '{lines.WORD}'").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: Fertility and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
