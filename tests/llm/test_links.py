"""Near duplicates with large Arrow batches, and components of chains, stars and rings."""

from __future__ import annotations

import random

import pytest

from barlake.llm import components, jaccard_join


def test_batches_of_any_size(spark):
    """More rows in an Arrow batch than a chunk may number: two copies of each of many short texts."""
    n = 70_000
    docs = spark.range(0, 2 * n, 1, 1).selectExpr("id as doc_id", f"concat('a b c d e f ', id % {n}) as text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        found = jaccard_join.near_duplicates(docs)
        # 2 shingles each, one of them shared by all: 1 of 3 is no link, so only equal texts are linked
        assert found.where(f"component_id <> doc_id % {n} or n_shingles <> 3").count() == 0
        assert found.count() == 2 * n
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_search(spark, seed):
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 520)] + [(i, 900 + (i + 1) % 9) for i in range(900, 909)]
    edges += [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(7, 7)]
    near: dict[int, set] = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    want, done = {}, set()
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in done:
                done.add(x)
                want[x] = start
                todo += near[x]
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len(want) and {x["node"]: x["component"] for x in got} == want
