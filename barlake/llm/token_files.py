"""Token-id shards with a minimal perfect hash index per shard.

A dataset is a Parquet folder with one row per shard, written by Spark's committer, so a lost executor only repeats
its tasks. Shards follow each other in key order: `part` is the range of keys, `seq` the place within it. Columns:

    part, seq            order of the shard
    n_docs, n_tokens     size
    first_key, last_key  smallest and largest key (row group statistics prune lookups of few keys)
    width                bytes per id: 2 where every id of the shard fits, else 4
    payload              all ids, little endian, one document after another
    bounds               n_docs + 1 offsets into the ids, uint64
    keys                 the keys in order, int64; none in shards of documents without key
    firsts               first row of each distinct key, and the number of rows, uint32
    pilots               uint32 per bucket of the hash function, about 4 keys each
    slots                per slot of the minimal perfect hash: fingerprint and ordinal of the distinct key, uint32 each

A keyed read hashes the key to a bucket, the bucket's pilot to a slot, compares the fingerprint, then the key, and
cuts the payload: constant time, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm import tokens
from barlake.llm.common import columns, release, shared_folder
from barlake.llm.words import mix, slices

SHARD_IDS = 4_000_000
SLICE_BYTES = 3_000_000
KEYS_PER_BUCKET = 4
DIRECT = 1 << 31

SCHEMA = (
    "part int, seq int, n_docs long, n_tokens long, first_key long, last_key long, width int, payload binary, "
    "bounds binary, keys binary, firsts binary, pilots binary, slots binary"
)


def key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def place(h: np.ndarray, pilot, size: int) -> np.ndarray:
    return (mix(h ^ mix(np.asarray(pilot, np.uint64) + np.uint64(1))) % np.uint64(size)).astype(np.int64)


def buckets(h: np.ndarray, count: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(count)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots and slots for distinct keys: large buckets first, each tries pilots until its keys fall into free slots.

    Buckets with one key come last and store their free slot itself (marked by the high bit), so the table is full.
    """
    size = len(keys)
    count = -(-size // KEYS_PER_BUCKET) or 1
    pilots, slots = np.zeros(count, np.uint32), np.zeros((size, 2), np.uint32)
    h = key_hash(keys)
    if len(np.unique(h)) < size:
        raise ValueError("keys of a shard must differ")
    bucket = buckets(h, count)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(count + 1))
    taken = np.zeros(size, bool)
    where = np.zeros(size, np.int64)
    sizes = np.diff(starts)
    tries = np.arange(64, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        n = sizes[b]
        if n < 2:
            break
        own = order[starts[b] : starts[b + 1]]
        base = 0
        while True:
            spots = place(h[own][None, :], (tries + np.uint64(base))[:, None], size)
            ok = ~taken[spots].any(1)
            if n > 1:
                ok &= (np.diff(np.sort(spots, 1), axis=1) > 0).all(1)
            if ok.any():
                k = int(ok.argmax())
                pilots[b] = base + k
                where[own] = spots[k]
                taken[spots[k]] = True
                break
            base += len(tries)
            if base >= DIRECT:
                raise ValueError("no pilot found")
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(sizes == 1)
    own = order[starts[single]]
    where[own] = free
    pilots[single] = free.astype(np.uint32) | np.uint32(DIRECT)
    slots[where, 0] = fingerprint(h)
    slots[where, 1] = np.arange(size)
    return pilots, slots


def find(keys: np.ndarray, pilots: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Ordinal of each key among the distinct keys of the shard, or -1 where the fingerprint differs."""
    if not len(slots):
        return np.full(len(keys), -1, np.int64)
    h = key_hash(keys)
    pilot = pilots[buckets(h, len(pilots))]
    spot = np.where(pilot & np.uint32(DIRECT), (pilot & np.uint32(DIRECT - 1)).astype(np.int64), place(h, pilot, len(slots)))
    hit = slots[spot]
    return np.where(hit[:, 0] == fingerprint(h), hit[:, 1].astype(np.int64), -1)


def _shard(part: int, seq: int, keys: np.ndarray | None, ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
    """A shard of documents with these ascending keys, or of documents without keys (None)."""
    flat = np.concatenate(ids)
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.uint64)
    keyed = keys is not None
    keys = keys if keyed else np.zeros(0, np.int64)
    distinct, firsts = np.unique(keys, return_index=True)
    pilots, slots = build_index(distinct)
    row = {
        "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(bounds) - 1], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64()),
        "first_key": pa.array([int(keys[0]) if keyed else None], pa.int64()), "last_key": pa.array([int(keys[-1]) if keyed else None], pa.int64()), "width": pa.array([width], pa.int32()),
    }
    firsts = np.append(firsts, len(keys)).astype(np.uint32)
    for name, data in (("payload", flat.astype(f"<u{width}")), ("bounds", bounds), ("keys", keys), ("firsts", firsts), ("pilots", pilots), ("slots", slots)):
        row[name] = pa.array([data.tobytes()], pa.binary())
    return pa.RecordBatch.from_pydict(row)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Encode every whole text, `end_id` after each, and write shards in ascending doc_id order.

    Null text counts as empty. Rows without doc_id come last, in shards of their own that no key finds. Repeated doc_ids
    keep all their rows: the index holds the distinct keys, and a lookup returns every row of a key. Rows are dealt by
    doc_id and a hash of the text, so those of one repeated doc_id may be spread over several shards.
    """

    def shards(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys, ids, sizes, used, keyed = [], [], [], 0, True

        def shard():
            return _shard(part, seq, np.concatenate(keys) if keyed else None, ids, sizes)

        for batch in rows:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            own = batch.column(0).fill_null(0).to_numpy()
            for a, b in slices(batch.column(1), SLICE_BYTES):
                flat, at = tokens.with_ends(*tokens.word_ids(batch.column(1).slice(a, b - a), vocabulary), end_id)
                begin, last_keyed = 0, int(known[a:b].sum())
                while begin < b - a:
                    end = int(np.searchsorted(at, at[begin] + SHARD_IDS - used, "right")) - 1
                    end = min(end, last_keyed) if begin < last_keyed else end
                    if ids and (end <= begin or keyed != (begin < last_keyed)):
                        yield shard()
                        seq, keys, ids, sizes, used = seq + 1, [], [], [], 0
                        continue
                    end, keyed = max(end, begin + 1), begin < last_keyed
                    keys.append(own[a + begin : a + end])
                    ids.append(flat[at[begin] : at[end]])
                    sizes.append(np.diff(at[begin : end + 1]))
                    used += int(at[end] - at[begin])
                    begin = end
        if ids:
            yield shard()
        release()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = columns(docs, "doc_id", "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(shards, SCHEMA).write.option("compression", "zstd").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids of all shards before each shard: a running sum over parts, then within a part (counts only)."""
    sizes = spark.read.parquet(path).select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.join(parts.select("part", before.alias("_before")), "part").select("part", "seq", (F.col("_before") + inside).alias("base"))


class Shard:
    """Views of one stored shard; nothing is copied, sorted or decoded but what is asked for."""

    def __init__(self, row: dict):
        self.bounds, self.ids = np.frombuffer(row["bounds"], np.uint64), np.frombuffer(row["payload"], f"<u{row['width']}")
        self.keys, self.firsts = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["firsts"], np.uint32)
        self.pilots, self.slots = np.frombuffer(row["pilots"], np.uint32), np.frombuffer(row["slots"], np.uint32).reshape(-1, 2)

    def rows_of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Wanted keys and the rows that have them: through the index to the key's first row, checked against the key."""
        at = find(wanted, self.pilots, self.slots)
        at, wanted = at[at >= 0], wanted[at >= 0]
        first, last = self.firsts[at].astype(np.int64), self.firsts[at + 1].astype(np.int64)
        real = self.keys[first] == wanted
        first, count, wanted = first[real], (last - first)[real], wanted[real]
        rows = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(wanted, count), rows

    def document(self, row: int) -> np.ndarray:
        return self.ids[int(self.bounds[row]) : int(self.bounds[row + 1])]


STORED = ["width", "payload", "bounds", "keys", "firsts", "pilots", "slots"]


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Read every document back, those with keys through the index: doc_id, start, n_tokens, ids_crc32."""

    def rows(shards: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards:
            for row in batch.to_pylist():
                shard = Shard(row)
                if len(shard.keys):
                    keys, at = shard.rows_of(shard.keys[shard.firsts[:-1]])
                    doc_id = pa.array(keys)
                else:
                    at = np.arange(len(shard.bounds) - 1)
                    doc_id = pa.nulls(len(at), pa.int64())
                inside = shard.bounds[at].astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * len(at), pa.int32()), "seq": pa.array([row["seq"]] * len(at), pa.int32()),
                        "doc_id": doc_id, "inside": pa.array(inside), "n_tokens": pa.array(shard.bounds[at + 1].astype(np.int64) - inside),
                        "ids_crc32": pa.array([zlib.crc32(shard.document(r).astype("<u4").tobytes()) for r in at.tolist()], pa.int64()),
                    }
                )

    shards = spark.read.parquet(path).select("part", "seq", *STORED)
    read = shards.mapInArrow(rows, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """Ids of the given documents (doc_id, ids): only shards whose key range holds one of them are read."""
    wanted = np.unique(np.array([k for k in keys if k is not None], np.int64))

    def rows(shards: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards:
            for row in batch.to_pylist():
                shard = Shard(row)
                found, at = shard.rows_of(wanted)
                ids = pa.array([shard.document(r).astype(np.int64) for r in at.tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(found), "ids": ids})

    shards = spark.read.parquet(path)
    if not len(wanted):
        shards = shards.limit(0)
    else:
        some = F.lit(False)
        for k in wanted.tolist():
            some |= (F.col("first_key") <= k) & (F.col("last_key") >= k)
        shards = shards.where(some)
    return shards.select(*STORED).mapInArrow(rows, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    path = shared_folder(spark, "token-ids")
    write(docs, path, vocabulary, end_id)
    return digest(spark, path)
