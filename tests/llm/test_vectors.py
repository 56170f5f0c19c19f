"""Top-k search and hard negatives against plain loops over all pairs."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from barlake.llm import negatives, topk, vectors

TABLE = "vec_id long, embedding array<float>, label int, bucket string, norm string, _kind int"


def table(n: int, width: int, seed: int, copies: float = 0.3) -> list[tuple]:
    """Random vectors of very different lengths, groups of near copies, ties, and every kind of unusable row."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(5, width))
    out = []
    for i in range(n):
        v = base[r.integers(5)] + r.normal(size=width) * 0.02 if r.random() < copies else r.normal(size=width) * r.choice([0.05, 0.3, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], int(r.choice([0, 0, 0, 1, 2, 3])) if i % 11 else None))
    zero = [0.0] * width
    out[40] = (40, out[20][1], out[20][2])
    out[41] = (41, out[20][1], 1)
    out += [out[0], out[60], (60, out[61][1], 2), (None, out[1][1], 0), (n, None, 1), (n + 1, [None] + zero[1:], 1), (n + 2, [math.nan] + zero[1:], 1)]
    out += [(n + 3, [math.inf] + zero[1:], 1), (20 * n, zero, 1), (20 * n + 1, [], 1), (20 * n + 20, [], 2), (20 * n + 40, out[3][1][: width // 2], 0)]
    out += [(-20, out[5][1], 1), (20 * n + 100, [3.0e38] * width, 1)]
    return [(*row, "clash", "clash", 7) for row in out]


def usable(rows, scale, labelled=False):
    """Distinct (vec_id, label, integers) as the docstring of `quantised` says."""
    found = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or labelled and label is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(scale * x) for x in v)
        if sum(x * x for x in whole) < 2**62 and (vec_id, label, whole) not in found:
            found.append((vec_id, label, whole))
    return found


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k, every, scale):
    rows, out = usable(rows, scale), []
    for vec_id, _, q in rows:
        if vec_id % every == 0:
            scores = sorted((-dot(q, c), i) for i, _, c in rows if i != vec_id)[:k]
            out += [(vec_id, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def brute_negatives(rows, every, positives, k, scale, low, high):
    rows, out = usable(rows, scale, True), []
    for anchor, label, q in rows:
        if anchor % every:
            continue
        scores = sorted((-dot(q, c), i, own) for i, own, c in rows if i != anchor)
        for s, positive, _ in [x for x in scores if x[2] == label][:positives]:
            band = [(-t, i) for t, i, own in scores if own != label and low * -s <= 100 * -t <= high * -s][:k]
            out += [(anchor, positive, rank, i, -s, t) for rank, (t, i) in enumerate(band, 1)]
    return sorted(out)


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


TOP = ("query_id", "rank", "vec_id", "score")
HARD = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET_ROWS", 37)


@pytest.mark.parametrize("width,seed", [(16, 1), (3, 2)])
def test_top_k_equals_all_pairs(spark, small, width, seed):
    rows = table(400, width, seed)
    df = spark.createDataFrame(rows, TABLE).repartition(3)
    assert got(topk.top_k(df, k=7, every=20, scale=64.0), *TOP) == brute_top(rows, 7, 20, 64)
    assert got(topk.top_k(df, k=500, every=100, scale=64.0), *TOP) == brute_top(rows, 500, 100, 64)


@pytest.mark.parametrize("width,seed,low,high", [(16, 1, 80, 100), (3, 2, 50, 90)])
def test_hard_negatives_equal_all_pairs(spark, small, width, seed, low, high):
    rows = table(400, width, seed)
    df = spark.createDataFrame(rows, TABLE).repartition(3)
    found = got(negatives.hard_negatives(df, every=20, positives=4, negatives=3, scale=256.0, low=low, high=high), *HARD)
    assert found == brute_negatives(rows, 20, 4, 3, 256, low, high)
    assert found


def test_large_components_are_exact(spark, small):
    """Products beyond 2**53, where doubles would round."""
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=4) * 2.0**22], i % 3, "", "", 0) for i in range(120)]
    df = spark.createDataFrame(rows, TABLE)
    assert got(topk.top_k(df, k=9, every=20, scale=64.0), *TOP) == brute_top(rows, 9, 20, 64)
    assert got(negatives.hard_negatives(df, every=20, scale=64.0), *HARD) == brute_negatives(rows, 20, 5, 5, 64, 80, 100)


def test_few_or_no_rows(spark):
    none = spark.createDataFrame([], TABLE)
    assert topk.top_k(none).collect() == [] and negatives.hard_negatives(none).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, "", "", 0)], TABLE)
    assert topk.top_k(one).collect() == [] and negatives.hard_negatives(one).collect() == []
    null = spark.createDataFrame([(0, None, 1, "", "", 0), (None, None, None, None, None, None)], TABLE)
    assert topk.top_k(null).collect() == [] and negatives.hard_negatives(null).collect() == []
    bare = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert got(topk.top_k(bare), *TOP) == [(0, 1, 1, 64 * 128)]


def test_both_ways_of_pruning_are_taken():
    """Near copies are found through coordinate lists, others by length; short buckets are left out whole."""
    r = np.random.default_rng(3)
    base = r.normal(size=(1, 32))
    near = np.floor(64 * (base + r.normal(size=(40, 32)) * 0.01)).astype(np.int64)
    others = np.floor(64 * r.normal(size=(2000, 32)) * 0.5).astype(np.int64)

    def bucket(whole):
        whole = whole[np.argsort(-np.linalg.norm(whole, axis=1), kind="stable")]
        norms = np.linalg.norm(whole, axis=1)
        sizes = np.array([(32, 128)] * len(whole), np.int32)
        return vectors.Bucket({
            "ids": np.arange(len(whole)).tobytes(), "labels": np.zeros(len(whole), np.int64).tobytes(), "norms": norms.tobytes(), "top": norms.max(),
            "sizes": sizes.tobytes(), "data": whole.astype("<i4").tobytes(),
        })

    queries, long, short = bucket(np.concatenate([near[:1], others[:30]])), bucket(np.concatenate([near, others])), bucket(others // 64)
    best = vectors.Best(len(queries.ids), 10)
    topk._search(best, queries, long, np.full(len(queries.ids), topk.NOTHING))
    again = vectors.Best(len(queries.ids), 10)
    ways = topk._search(again, queries, long, best.least())
    assert ways["coordinate"] >= 1 and ways["length"] >= 1
    assert (again.scores == best.scores).all() and (again.ids == best.ids).all()
    assert topk._search(again, queries, short, best.least())["pruned"] == len(queries.ids)


def test_threshold_stops_early_and_keeps_ties():
    """Few scores are computed where an anchor's lists tell the best rows; rows that tie with the kth are met."""
    r = np.random.default_rng(4)
    whole = r.integers(-5, 5, size=(4000, 6))
    whole[1000:1010] = 400
    whole[3000:3010] = 400
    sizes = np.array([(6, 24)] * len(whole), np.int32)
    make = lambda rows, ids: vectors.Bucket({
        "ids": ids.astype(np.int64).tobytes(), "labels": np.zeros(len(rows), np.int64).tobytes(), "norms": np.linalg.norm(rows, axis=1).tobytes(),
        "top": float(np.linalg.norm(rows, axis=1).max()), "sizes": sizes[: len(rows)].tobytes(), "data": rows.astype("<i4").tobytes(),
    })
    ids = r.permutation(len(whole))
    bucket, anchor = make(whole, ids), make(np.full((1, 6), 3), np.array([-1]))
    best = vectors.Best(1, 5)

    def offer(part, rows, score, fresh):
        best.offer(part, score, fresh, bucket.ids[rows])

    # a window that already knows a low score
    best.add(np.zeros(5, np.int64), np.full(5, 200), np.arange(10**6, 10**6 + 5))
    scored = negatives.search_bucket(anchor, bucket, best.least, offer)
    assert scored < len(whole) / 2
    assert best.ids[0].tolist() == sorted(ids[[*range(1000, 1010), *range(3000, 3010)]])[:5]


def test_queries_equal_their_sql(spark, tmp_path):
    from barlake.llm.queries import QUERIES

    rows = [(i, v, label) for i, v, label, *_ in table(300, 8, 9) if i != 20 * 300 + 100]
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "Int64", "label": "Int32"})
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert len(frame) == con.execute("select count(*) from embeddings").fetchone()[0]
    for name, names, sql in (("op12_top_k", TOP, topk.SQL), ("op11_hard_negatives", HARD, negatives.SQL)):
        wanted = sorted(con.execute(f"select {', '.join(names)} from ({sql})").fetchall())
        assert got(QUERIES[name](spark, str(tmp_path)), *names) == wanted
