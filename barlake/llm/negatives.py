"""Hard negatives by Fagin's threshold algorithm over buckets of integer vectors.

A bucket has one list of its rows per dimension, sorted by value. An anchor reads the list of each dimension in which
it is not zero: from the largest value down where its own component is positive, from the smallest up where it is
negative (sorted access). Every row met is scored by its whole integer product (random access). After r rows of each
list no row not yet met can score more than the threshold, the product of the anchor with the last values read. An
anchor is done with a bucket once the threshold is strictly below the kth score of each of its windows.

The windows of the first search are the best rows of the anchor's label (its positives). Those of the second are, per
positive, the best rows of other labels whose score lies in the band of that positive; a window never needs a score
below its band. Windows live on from bucket to bucket, so later buckets are mostly left after a few rows.

The threshold depends on the depth only, so it is known for a whole ladder of depths at once. Where it says that an
anchor will have read about as many list entries as the bucket has rows, all rows are scored in one product instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import stored
from barlake.llm.vectors import EXACT, Best, Bucket, buckets, products, quantised, searched

#: Anchors scored at once against a whole bucket, and the first depth of sorted access; each further one is four times as deep.
AT_ONCE, DEPTH = 128, 8
BOTTOM, TOP = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class SortedLists:
    """Rows of a bucket per dimension, largest value first."""

    def __init__(self, bucket: Bucket):
        self.order = np.argsort(-bucket.whole, axis=0, kind="stable")
        self.values = np.take_along_axis(bucket.whole, self.order, axis=0)
        self.n, self.width = bucket.whole.shape

    def depths(self) -> list[int]:
        out, depth = [], DEPTH
        while depth < self.n:
            out.append(depth)
            depth *= 4
        return [*out, self.n]

    def thresholds(self, anchors: Bucket, depth: int) -> np.ndarray:
        """Most that a row can score for each anchor if it is not among the first `depth` rows of any list read."""
        down, up = self.values[depth - 1], self.values[self.n - depth]
        a = anchors.whole[:, : self.width]
        down, up = down[: a.shape[1]], up[: a.shape[1]]
        if anchors.top * float(np.abs(self.values).max(initial=0)) * max(1, a.shape[1]) < EXACT:
            a, down, up = a.astype(np.float64), down.astype(np.float64), up.astype(np.float64)
            return (np.maximum(a, 0) @ down + np.minimum(a, 0) @ up).astype(np.int64)
        exact = np.maximum(a, 0).astype(object) @ down.astype(object) + np.minimum(a, 0).astype(object) @ up.astype(object)
        return np.array([min(max(int(x), BOTTOM), TOP) for x in exact], np.int64)

    def read(self, anchor: np.ndarray, depth: int) -> np.ndarray:
        """Distinct rows among the first `depth` of each list of the anchor."""
        anchor = anchor[: self.width]
        down, up = self.order[:depth, np.flatnonzero(anchor > 0)], self.order[self.n - depth :, np.flatnonzero(anchor < 0)]
        return np.unique(np.concatenate([down.ravel(), up.ravel()]))


def search_bucket(anchors: Bucket, bucket: Bucket, level, offer, lists: SortedLists | None = None) -> int:
    """Sorted and random access until each anchor's threshold is strictly below its `level()`; rows met are offered.

    `level()` gives the score that each anchor still needs, `offer(anchor rows, bucket rows, scores)` takes a matrix of
    scores. An anchor that is zero in all dimensions of the bucket reads no list: its threshold is 0 from the start, so
    all rows are scored unless 0 is below its level. Returns how many scores were computed.
    """
    lists = lists or SortedLists(bucket)
    depths = lists.depths()
    bound = np.stack([lists.thresholds(anchors, 1), *[lists.thresholds(anchors, d) for d in depths]])
    used = (anchors.whole[:, : lists.width] != 0).sum(1)
    active, scored = np.flatnonzero(bound[0] >= level()), 0
    seen: dict[int, np.ndarray] = {}
    for step, depth in enumerate(depths):
        if not len(active):
            break
        need = level()[active]
        # the first depth of the ladder at which the threshold is below what is needed now
        stops = np.array(depths)[np.argmax(np.vstack([bound[1:-1, active] < need[None, :], np.ones((1, len(active)), bool)]), axis=0)]
        everything = (stops * used[active] >= lists.n) | (used[active] == 0)
        for at in range(0, int(everything.sum()), AT_ONCE):
            part = active[everything][at : at + AT_ONCE]
            old = [seen.get(a) for a in part]
            score = products(anchors, part, bucket)
            scored += score.size
            fresh = np.ones(score.shape, bool)
            for i, rows in enumerate(old):
                if rows is not None:
                    fresh[i, rows] = False
            offer(part, np.arange(lists.n), score, fresh)
        active = active[~everything]
        for a in active:
            rows = lists.read(anchors.whole[a], depth)
            new = rows if a not in seen else np.setdiff1d(rows, seen[a], assume_unique=True)
            seen[a] = rows
            scored += len(new)
            offer(np.array([a]), new, products(anchors, [a], bucket, new), np.ones((1, len(new)), bool))
        # strictly below: a row not met may still tie and have a smaller id
        active = active[bound[step + 1, active] >= level()[active]]
    return scored


POSITIVES = "block long, place int, anchor_id long, score long, vec_id long"
NEGATIVES = "block long, place int, aim int, anchor_id long, positive_id long, positive_score long, score long, vec_id long"


def _positives(head: dict, found: Iterator[dict], k: int) -> Iterator[pa.RecordBatch]:
    anchors = Bucket(head)
    best = Best(len(anchors.ids), k)

    for row in found:
        bucket = Bucket(row)

        def offer(part, rows, score, fresh):
            ok = fresh & (bucket.labels[rows][None, :] == anchors.labels[part][:, None]) & (bucket.ids[rows][None, :] != anchors.ids[part][:, None])
            best.offer(part, score, ok, bucket.ids[rows])

        search_bucket(anchors, bucket, best.least, offer)
    window, score, ids = best.found()
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), head["bucket"], np.int64)), pa.array(window, pa.int32()), pa.array(anchors.ids[window]), pa.array(score), pa.array(ids)],
        ["block", "place", "anchor_id", "score", "vec_id"],
    )


def _share(percent: int, score: np.ndarray, up: bool) -> np.ndarray:
    """percent / 100 of a score, rounded up or down, without leaving the range of longs."""
    whole, rest = score // 100, score % 100 * percent
    return percent * whole + (-(-rest // 100) if up else rest // 100)


def _negatives(head: dict, found: Iterator[dict], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    anchors, aims = Bucket(head), head["aims"]
    place, rank = np.array([a["place"] for a in aims]), np.array([a["rank"] for a in aims]) - 1
    width = int(rank.max()) + 1
    ids, scores = np.zeros((len(anchors.ids), width), np.int64), np.zeros((len(anchors.ids), width), np.int64)
    there = np.zeros(ids.shape, bool)
    there[place, rank], ids[place, rank], scores[place, rank] = True, [a["vec_id"] for a in aims], [a["score"] for a in aims]
    floor, ceiling = _share(low, scores, True), _share(high, scores, False)
    there &= floor <= ceiling
    best = Best(ids.size, k)

    def wanted():
        """Per window the score that a newcomer must reach; no score is enough for a window that cannot be met."""
        return np.where(there, np.maximum(floor, best.least().reshape(ids.shape)), TOP)

    for row in found:
        bucket = Bucket(row)

        def offer(part, rows, score, fresh):
            fresh = fresh & (bucket.labels[rows][None, :] != anchors.labels[part][:, None]) & (bucket.ids[rows][None, :] != anchors.ids[part][:, None])
            need = wanted()[part]
            for w in range(width):
                ok = fresh & there[part, w][:, None] & (score >= need[:, w][:, None]) & (score <= ceiling[part, w][:, None])
                best.offer(part * width + w, score, ok, bucket.ids[rows])

        search_bucket(anchors, bucket, lambda: wanted().min(1), offer)
    window, score, found_ids = best.found()
    a, w = window // width, window % width
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(a), head["bucket"], np.int64)), pa.array(a, pa.int32()), pa.array(w + 1, pa.int32()), pa.array(anchors.ids[a]),
            pa.array(ids[a, w]), pa.array(scores[a, w]), pa.array(score), pa.array(found_ids),
        ],
        ["block", "place", "aim", "anchor_id", "positive_id", "positive_score", "score", "vec_id"],
    )


def _ranked(hits: DataFrame, window: list[str], k: int) -> DataFrame:
    best_first = Window.partitionBy(*window).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, scale: float = 256.0, low: int = 80, high: int = 100
) -> DataFrame:
    """Per anchor and positive the best rows of other labels that score `low` to `high` percent of the positive's score.

    Anchors are the rows whose vec_id is divisible by `every`; positives are the best `positives` other rows of an
    anchor's label. Scores are integer inner products; ties go to the smaller vec_id. A positive of negative score has
    an empty band. Rows without label take no part, nor those named in `vectors.quantised`; rows that share the
    anchor's vec_id are never its partners. Columns: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. An empty table gives no rows.
    """
    rows = quantised(vectors.where("label is not null"), scale)
    by_label = [F.col("label"), F.col("vec_id")]
    candidates = buckets(rows, by_label, "labelled")
    blocks = buckets(rows.where(F.col("vec_id") % every == 0), by_label, "anchors")
    order = F.lit(0.0)

    same = (F.col("low_label") <= F.col("q_high_label")) & (F.col("high_label") >= F.col("q_low_label"))
    hits = searched(blocks, candidates, same, order, lambda head, found: _positives(head, found, positives), POSITIVES)
    aims = _ranked(hits, ["block", "place"], positives).groupBy(F.col("block").alias("bucket"))
    aims = aims.agg(F.sort_array(F.collect_list(F.struct("place", "rank", "vec_id", "score"))).alias("aims"))  # of one block of bounded size
    aimed = stored(blocks.join(aims, "bucket"), "aims")

    single = lambda p: F.col(f"{p}low_label") == F.col(f"{p}high_label")
    other = ~(single("") & single("q_") & (F.col("low_label") == F.col("q_low_label")))
    hits = searched(aimed, candidates, other, order, lambda head, found: _negatives(head, found, negatives, low, high), NEGATIVES, ("aims",))
    ranked = _ranked(hits, ["block", "place", "aim"], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), n as (select *, row_number() over () as row from v), s as (
  select a.row, a.vec_id as anchor_id, c.row as other, c.vec_id, a.label = c.label as same,
         cast(coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])), 0) as bigint) as score
  from n a join n c on a.vec_id <> c.vec_id
  where a.vec_id % 100 = 0
), p as (
  select row, anchor_id, r, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by row order by score desc, vec_id, other) as r from s where same)
  where r <= 5
), b as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.row, p.r order by s.score desc, s.vec_id) as rank
  from p join s on s.row = p.row and not s.same
   and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from b where rank <= 5
"""
