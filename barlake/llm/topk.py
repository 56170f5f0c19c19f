"""Exact top-k search by inner product: buckets of similar length, pruning by local cosine thresholds, verified products.

Candidates are sorted by length, longest first, and cut into buckets. The bucket of the longest vectors gives every query
a first kth score; a query needs score s from a bucket of lengths up to l only if s / (|q| l), its local cosine threshold
there, is at most 1. Queries are blocked by s / |q|, so that a block skips short buckets as a whole.

Inside a bucket each query takes one of two ways, chosen by its threshold t there: coordinates where t is high and the
first range holds few rows, else length.

* length: the rows with |q| |p| >= s, a prefix of the bucket, and
* coordinate: for the query's largest coordinates f, a unit vector p with cosine >= t has p_f between
  t q_f -+ sqrt((1 - t^2)(1 - q_f^2)); rows inside these ranges of the bucket's sorted coordinate lists are candidates.

Candidates are verified by exact integer products, and the kth score rises from bucket to bucket. Bounds are relaxed by a
relative 1e-9 for rounding; a bound equal to the kth score is never pruned, as a smaller id may win the tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import stored
from barlake.llm.vectors import ROWS, Best, Bucket, bucket_of, buckets, products, quantised, searched

SLACK = 1e-9
#: Rows of a block that are multiplied at once, and coordinates that a query looks at.
AT_ONCE, FOCUS = 256, 3
#: The coordinate way is tried above this local cosine threshold, and taken if the first range holds at most this share of the rows.
NEAR, FEW = 0.7, 0.1
HITS = "block long, place int, query_id long, score long, vec_id long"
NOTHING = np.iinfo(np.int64).min


class Lists:
    """Sorted unit coordinates of a bucket, one list per coordinate, made when a query first asks for it."""

    def __init__(self, bucket: Bucket):
        norms = np.sqrt((bucket.real**2).sum(1))
        self.unit = bucket.real / np.where(norms > 0, norms, 1)[:, None]
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, f: int, low: float, high: float) -> np.ndarray:
        if f not in self.made:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.made[f] = (self.unit[order, f], order)
        values, order = self.made[f]
        return order[np.searchsorted(values, low) : np.searchsorted(values, high, "right")]


def _coordinate(lists: Lists, unit: np.ndarray, t: float, enough: int) -> np.ndarray | None:
    """Rows inside the feasible ranges of the query's largest coordinates; None if no range is narrow."""
    focus = np.argsort(-np.abs(unit[: lists.unit.shape[1]]), kind="stable")[:FOCUS]
    rows = None
    for f in focus:
        half = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2)))
        # where the query itself is closer to an axis than t allows, vectors of that direction are inside too
        low = -1.1 if -unit[f] >= t else t * unit[f] - half - 1e-7
        high = 1.1 if unit[f] >= t else t * unit[f] + half + 1e-7
        if rows is None:
            rows = lists.near(int(f), low, high)
            if len(rows) > enough:
                return None
        else:
            inside = lists.unit[rows, f]
            rows = rows[(inside >= low) & (inside <= high)]
    return rows


def _search(best: Best, block: Bucket, bucket: Bucket, need: np.ndarray) -> dict[str, int]:
    """Put the bucket's rows that reach each query's kth score into `best`; counts of the ways taken."""
    norms = block.norms
    reach = norms * bucket.top * (1 + SLACK) >= need
    ways = {"pruned": int((~reach).sum()), "coordinate": 0, "length": 0}
    lengths = -bucket.norms  # ascending: the bucket is sorted by length, longest first
    width = np.where(norms > 0, norms, 1) * max(bucket.top, 1e-300)
    cosine = np.where(norms > 0, need / width, 0.0) - SLACK
    near = np.flatnonzero(reach & (cosine > NEAR))
    whole = np.flatnonzero(reach & ~(cosine > NEAR)).tolist()
    lists = Lists(bucket) if len(near) else None
    for q in near:
        rows = _coordinate(lists, block.real[q] / norms[q], min(float(cosine[q]), 1.0), int(FEW * len(bucket.ids)))
        if rows is None:
            whole.append(q)
            continue
        ways["coordinate"] += 1
        if len(rows):
            score = products(block, [q], bucket, rows)[0]
            ok = (score >= need[q]) & (bucket.ids[rows] != block.ids[q])
            best.offer(np.array([q]), score[None, :], ok[None, :], bucket.ids[rows])
    ways["length"] = len(whole)
    whole = np.array(whole, np.int64)
    for at in range(0, len(whole), AT_ONCE):
        part = whole[at : at + AT_ONCE]
        least = np.where(norms[part] > 0, need[part] / np.where(norms[part] > 0, norms[part], 1), 0) * (1 - SLACK)
        prefix = int(np.searchsorted(lengths, -max(0.0, least.min()) + SLACK, "right")) if (least > 0).all() else len(lengths)
        score = products(block, part, bucket, slice(0, prefix))
        ok = (score >= need[part][:, None]) & (bucket.ids[None, :prefix] != block.ids[part][:, None])
        best.offer(part, score, ok, bucket.ids[:prefix])
    return ways


def _hits(block: Bucket, number: int, best: Best) -> pa.RecordBatch:
    window, score, ids = best.found()
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), number, np.int64)), pa.array(window, pa.int32()), pa.array(block.ids[window]), pa.array(score), pa.array(ids)],
        ["block", "place", "query_id", "score", "vec_id"],
    )


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """The k highest integer products of each query row with the other rows: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows of other vec_ids. Ties go to the
    smaller vec_id. Rows that take no part: see `vectors.quantised`. Different vectors under one vec_id are candidates
    and queries of their own. Further columns are not read; an empty table gives no rows.
    """
    rows = quantised(vectors, scale)
    by_length = [F.desc("norm"), F.col("vec_id")]
    candidates = buckets(rows, by_length, "lengths")
    first = candidates.agg(F.max_by("bucket", F.struct("top", -F.col("bucket")))).first()[0]
    seed = candidates.where(F.col("bucket") == first).first().asDict() if first is not None else None  # one bucket of bounded size

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's kth score in the bucket of the longest rows, and what cosine and length it must find elsewhere."""
        longest = Bucket(seed) if seed else None
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                block = Bucket(bucket_of(part))
                best = Best(len(block.ids), k)
                _search(best, block, longest, np.full(len(block.ids), NOTHING))
                kth = best.least()
                need = np.where(kth > 0, kth / np.where(block.norms > 0, block.norms, 1), -1.0) * (1 - SLACK)
                yield part.append_column("need", pa.array(need)).append_column("kth", pa.array(kth))

    # queries of similar need share a block
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "norm", "size", "data")
    seeds = stored(asked.mapInArrow(seeded, ROWS + ", need double, kth long"), "seeds")
    blocks = buckets(seeds, [F.col("need"), F.col("vec_id")], "blocks", ("need",), ("kth",))

    def search(head: dict, found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        block = Bucket(head)
        best, kth = Best(len(block.ids), k), np.frombuffer(head["kth"], np.int64)
        for row in found:
            _search(best, block, Bucket(row), np.maximum(kth, best.least()))
        yield _hits(block, head["bucket"], best)

    hits = searched(blocks, candidates, F.col("top") >= F.col("q_need"), -F.col("top"), search, HITS, ("need", "kth"))
    best_first = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select distinct vec_id, label, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), n as (select *, row_number() over () as row from v), s as (
  select q.row, q.vec_id as query_id, c.vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) as bigint) as score
  from n q join n c on q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s)
where rank <= 20
"""
