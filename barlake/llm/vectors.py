"""Integer vectors: quantised rows, buckets of bounded size, and the deal of query blocks and buckets to tasks.

Searches of a query set against all rows work in blocks: queries are packed into blocks and candidates into buckets,
both of bounded bytes, and a task holds one block while the buckets that may matter to it stream past. Where there are
fewer blocks than cores each block is dealt several times, every time with another share of the buckets (a stripe), and
the results per query, at most k per stripe, are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import stored

BUCKET_BYTES = 4_000_000
BUCKET_ROWS = 8_192
#: Partitions of a search; each holds one or more (block, stripe) groups.
MOST_TASKS = 100_000
#: Scores below this are exact in double precision products.
EXACT = 2.0**52

ROWS = "vec_id long, label long, norm double, size int, data binary"
BUCKET = "bucket long, n int, top double, low_label long, high_label long, ids binary, labels binary, norms binary, sizes binary, data binary"
NO_LABEL = -(2**63)


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """One stored row per vector with the integers floor(scale * x), x as double, and its length.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id, nor vectors
    whose squared length does not fit a long (their products would not). An empty vector is a zero vector. Equal rows
    count once; different vectors under one vec_id are rows of their own.
    """
    kinds = {"vec_id": "long", "label": "long", "embedding": "array<double>"}
    have = set(vectors.columns)
    rows = vectors.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            base, flat = offsets[0], flat[offsets[0] : offsets[-1]]
            sizes = np.diff(offsets)
            if lists.null_count:
                sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, sizes)
            at = offsets[:-1] - base
            row = np.repeat(np.arange(len(sizes)), np.diff(offsets))
            with np.errstate(over="ignore", invalid="ignore"):
                whole_numbers = np.floor(scale * flat)
                bad = ~np.isfinite(whole_numbers)
                square = np.bincount(row, np.where(bad, 0, whole_numbers) ** 2, len(sizes))
            # below 2**62 as a double sum, so that the exact sum is below 2**63
            fits = (np.bincount(row, bad, len(sizes)) == 0) & (square < 2.0**62)
            fits &= lists.is_valid().to_numpy(zero_copy_only=False) & batch["vec_id"].is_valid().to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(fits)
            ok = np.where(bad | ~fits[row], 0, whole_numbers).astype(np.int64)
            data = [ok[at[i] : at[i] + sizes[i]] for i in keep]
            data = [(x.astype("<i4") if not len(x) or np.abs(x).max() < 2**31 else x.astype("<i8")).tobytes() for x in data]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(keep)), batch["label"].take(pa.array(keep)), pa.array(np.sqrt(square[keep])), pa.array(sizes[keep], pa.int32()), pa.array(data, pa.binary())],
                ["vec_id", "label", "norm", "size", "data"],
            )

    return stored(rows.mapInArrow(whole, ROWS).dropDuplicates(["vec_id", "label", "size", "data"]), "vectors")


def buckets(rows: DataFrame, order: list[Column], name: str, least: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Runs of rows in the given order, each of at most BUCKET_BYTES (one larger row alone), stored one row per bucket.

    Of the further double columns `least` a bucket has its rows' smallest value, of the long columns `lists` all values.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, used = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (used + len(row["data"]) > BUCKET_BYTES or len(held) >= BUCKET_ROWS):
                    yield _packed(number, held, least, lists)
                    number, held, used = number + 1, [], 0
                held.append(row)
                used += len(row["data"])
        if held:
            yield _packed(number, held, least, lists)

    schema = ", ".join([BUCKET, *[f"{c} double" for c in least], *[f"{c} binary" for c in lists]])
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(fill, schema), name)


def _packed(number: int, rows: list[dict], least: tuple[str, ...], lists: tuple[str, ...]) -> pa.RecordBatch:
    labels = np.array([NO_LABEL if r["label"] is None else r["label"] for r in rows], np.int64)
    out = {
        "bucket": pa.array([number], pa.int64()), "n": pa.array([len(rows)], pa.int32()), "top": pa.array([max(r["norm"] for r in rows)], pa.float64()),
        "low_label": pa.array([int(labels.min())], pa.int64()), "high_label": pa.array([int(labels.max())], pa.int64()),
    }
    blobs = {
        "ids": np.array([r["vec_id"] for r in rows], np.int64).tobytes(), "labels": labels.tobytes(), "norms": np.array([r["norm"] for r in rows]).tobytes(),
        "sizes": np.array([(r["size"], len(r["data"])) for r in rows], np.int32).tobytes(), "data": b"".join(r["data"] for r in rows),
    }
    out |= {name: pa.array([blob], pa.binary()) for name, blob in blobs.items()}
    out |= {c: pa.array([min(r[c] for r in rows)], pa.float64()) for c in least}
    out |= {c: pa.array([np.array([r[c] for r in rows], np.int64).tobytes()], pa.binary()) for c in lists}
    return pa.RecordBatch.from_pydict(out)


def bucket_of(batch: pa.RecordBatch) -> dict:
    """A record batch of quantised rows as one bucket."""
    return _packed(0, batch.to_pylist(), (), ()).to_pylist()[0]


class Bucket:
    """The rows of a bucket in memory: ids, labels, norms, and their integers as a zero-padded matrix of longs."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.norms, self.top = np.frombuffer(row["norms"]), row["top"]
        sizes = np.frombuffer(row["sizes"], np.int32).reshape(-1, 2)
        width, n = int(sizes[:, 0].max()), len(sizes)
        if (sizes == sizes[0]).all() and sizes[0, 1] == 4 * width:
            self.whole = np.frombuffer(row["data"], "<i4").astype(np.int64).reshape(n, width)
        else:
            self.whole, at = np.zeros((n, width), np.int64), 0
            for i, (size, used) in enumerate(sizes.tolist()):
                if size:
                    self.whole[i, :size] = np.frombuffer(row["data"][at : at + used], "<i4" if used == 4 * size else "<i8")
                at += used

    @property
    def real(self) -> np.ndarray:
        if not hasattr(self, "_real"):
            self._real = self.whole.astype(np.float64)
        return self._real


def products(a: Bucket, rows_a, b: Bucket, rows_b=slice(None)) -> np.ndarray:
    """Exact integer inner products of rows of two buckets; the shorter vectors count as padded with zeros."""
    width = min(a.whole.shape[1], b.whole.shape[1])
    if a.top * b.top < EXACT:
        return (a.real[rows_a, :width] @ b.real[rows_b, :width].T).astype(np.int64)
    return a.whole[rows_a, :width] @ b.whole[rows_b, :width].T


class Best:
    """The k best (score, id) of each of n windows: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.scores, self.ids = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)
        self.count = np.zeros(n, np.int64)

    def least(self) -> np.ndarray:
        """The score that a newcomer must reach; the smallest long while a window is not full."""
        return self.scores[:, -1]

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(window):
            return
        touched = np.unique(window)
        old = np.arange(self.k)[None, :] < self.count[touched][:, None]
        window = np.concatenate([window, np.repeat(touched, self.count[touched])])
        score, ids = np.concatenate([score, self.scores[touched][old]]), np.concatenate([ids, self.ids[touched][old]])
        # bitwise complement turns the order of longs without overflow
        order = np.lexsort((ids, ~score, window))
        window, score, ids = window[order], score[order], ids[order]
        first = np.searchsorted(window, window)
        place = np.arange(len(window)) - first
        kept = place < self.k
        window, place = window[kept], place[kept]
        self.scores[window, place], self.ids[window, place] = score[kept], ids[kept]
        self.count[touched] = np.bincount(window, minlength=self.n)[touched]

    def offer(self, windows: np.ndarray, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """Add a matrix of scores, one row per window and one column per id, where `ok` holds."""
        n = scores.shape[1]
        ok = ok & (scores >= self.least()[windows][:, None])
        if n > self.k and ok.sum() > 4 * self.k * len(windows):
            kth = np.partition(np.where(ok, scores, np.iinfo(np.int64).min), n - self.k, axis=1)[:, n - self.k]
            ok &= scores >= kth[:, None]
        w, c = np.nonzero(ok)
        self.add(windows[w], scores[w, c], ids[c])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, score and id of everything held."""
        window, place = np.nonzero(np.arange(self.k)[None, :] < self.count[:, None])
        return window, self.scores[window, place], self.ids[window, place]


def searched(
    blocks: DataFrame, candidates: DataFrame, matters: Column, order: Column, search: Callable, schema: str, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Run `search(block, buckets)` for every block of queries against the buckets for which `matters` holds.

    `blocks` and `candidates` are tables of buckets; `matters` sees the block's columns with the prefix q_ and the
    bucket's as they are, `extra` names further columns of the block. A task gets the block first, then the buckets in
    `order`, one at a time, and `search` yields record batches. Which block meets which bucket is found on their
    descriptions alone, in an equi-join on a share number that both are dealt to.
    """
    spark = blocks.sparkSession
    info = ["bucket", "n", "top", "low_label", "high_label"]
    described = blocks.select(*[F.col(c).alias(f"q_{c}") for c in (*info, *extra)])
    count = blocks.count()
    cores = spark.sparkContext.defaultParallelism
    stripes = max(1, -(-cores // max(1, count)))
    shares = stripes * max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // stripes))
    left = candidates.select(*info, F.pmod(F.xxhash64("bucket"), F.lit(shares)).alias("_share"))
    right = described.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    met = left.join(right, "_share").where(matters).select("bucket", F.col("q_bucket").alias("_block"), F.pmod("_share", F.lit(stripes)).alias("_stripe"))
    streamed = candidates.join(met, "bucket").select("_block", "_stripe", F.lit(1).alias("_kind"), order.alias("_order"), *candidates.columns, *[F.lit(None).alias(c) for c in extra])
    heads = blocks.select(
        F.col("bucket").alias("_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("_stripe"), F.lit(0).alias("_kind"),
        F.lit(None).cast("double").alias("_order"), *candidates.columns, *extra,
    )
    tasks = min(MOST_TASKS, max(1, count * stripes))
    dealt = heads.unionByName(streamed).repartition(tasks, "_block", "_stripe").sortWithinPartitions("_block", "_stripe", "_kind", "_order", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))
        head = next(rows, None)
        while head is not None:
            after: list = []

            def own():
                for row in rows:
                    if row["_kind"] == 0:
                        after.append(row)
                        return
                    yield row

            mine = own()
            yield from search(head, mine)
            for _ in mine:  # what the search left unread
                pass
            head = after[0] if after else None

    return dealt.mapInArrow(run, schema)
