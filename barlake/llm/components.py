"""Connected components of an edge table by alternating star operations, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    least = _both(edges).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    up = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    # both sides are dealt by u already, so sending one of them to all tasks would save nothing
    return up.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node points once to a smaller node that points nowhere: nothing would change any more."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("out")), F.struct(F.col("v").alias("n"), F.lit(0).alias("out")))).alias("e"), (F.col("u") < F.col("v")).alias("up"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.out").alias("out"), F.count("*").alias("all"), F.max("up").alias("up"))
    return nodes.where("up or out > 1 or out = 1 and all > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge: the smallest node that can be reached. Ends when nothing changes.

    Each round is a stored table; a node with many neighbours is a key of joins, never a list.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(edges):
        edges = stored(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
