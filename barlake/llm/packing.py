"""Best-fit packing into sequences of a fixed number of tokens, with a certificate per partition.

Pieces are spread over partitions by a hash of their place in the stored table, so rows without doc_id or with one
repeated doc_id spread too. Each partition packs its pieces best-fit decreasing and computes a
lower bound on its sequences from dual-feasible functions. A partition that meets its bound is certified and keeps
all sequences but the emptiest. Others keep their full sequences. The pieces of the rest go to the next round, where
pieces of different partitions meet in fewer, newly dealt partitions of bounded size and are packed again, until one
partition holds the rest or a round needs no fewer sequences than the one before; that round is discarded. Each round is
a stored table of lengths and keys only; texts are read once. Each row has the gap of its partition: sequences beyond
its lower bound, 0 if certified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm import tokens
from barlake.llm.common import columns, release, stored
from barlake.llm.words import slices

PIECES_PER_TASK = 200_000
SLICE_BYTES = 3_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A number of its own for each row of the stored pieces.
PLACED = PIECE + ", place long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of every document; null text counts as empty, so each document has at least one piece."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), [[], [], [], [], []]
            for a, b in slices(batch.column(1), SLICE_BYTES):
                flat, at = tokens.with_ends(*tokens.word_ids(batch.column(1).slice(a, b - a), vocabulary), end_id)
                data = memoryview(flat).cast("B")
                for key, first, last in zip(keys[a:b], at[:-1].tolist(), at[1:].tolist()):
                    for k, begin in enumerate(range(first, last, capacity)):
                        end = min(begin + capacity, last)
                        for column, value in zip(out, (key, k, begin - first, end - begin, zlib.crc32(data[4 * begin : 4 * end]))):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            places = pa.array(np.arange(place, place + len(out[0])))
            place += len(out[0])
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(out, kinds)], places], ["doc_id", "piece", "start", "length", "ids_crc32", "place"])
        release()

    return columns(docs, "doc_id", "text").mapInArrow(rows, PLACED)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins for `counts[l]` items of length l, the best over two families of dual-feasible functions.

    The first drops items below a threshold and counts those above its complement as whole bins; the second
    rounds lengths down to multiples of capacity / k, keeping exact multiples of capacity / (k + 1).
    """
    length = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * length).sum()) // capacity)
    for small in range(1, capacity // 2 + 1):
        value = np.where(length > capacity - small, capacity, np.where(length >= small, length, 0))
        best = max(best, -(-int((counts * value).sum()) // capacity))
    for k in range(1, 64):
        scaled = (k + 1) * length
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, length * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item of a descending list, and the fill of each bin.

    Bins are kept by free space; one integer has a bit for each free space that some bin has, so the tightest bin
    that still fits is found by a shift.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, fill, bins, offsets = 0, [], [], []
    for n in lengths:
        fits = present >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                present &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        left = room - n
        if left:
            if not by_room[left]:
                present |= 1 << left
            by_room[left].append(b)
    return bins, offsets, fill


PACKED = PLACED + ", sequence_id long, offset long, kept boolean, gap long"


def _round(items: DataFrame, tasks: int, capacity: int, number: int, last: bool) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        lengths = table["length"].to_pylist()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        keep = np.ones(len(fill), bool)
        if not last:
            keep = np.array(fill) == capacity if gap else keep
            keep[int(np.argmin(fill))] &= min(fill) == capacity
        own = np.array(bins, np.int64)
        top = (number << 56) | (TaskContext.get().partitionId() << 32)
        table = table.append_column("sequence_id", pa.array(own + top)).append_column("offset", pa.array(offsets, pa.int64()))
        table = table.append_column("kept", pa.array(keep[own])).append_column("gap", pa.array(np.full(len(own), gap, np.int64)))
        yield from table.to_batches()

    order = [F.desc("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("place")]
    dealt = items.repartition(tasks, F.xxhash64("place", F.lit(number))).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(rows, PACKED), "packed")


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequences for stored pieces of at most `capacity` tokens: their columns with sequence_id, offset and gap, without place.

    Rows are packed as they are, repeated ones too.
    """
    tasks = max(1, -(-items.count() // PIECES_PER_TASK))
    done, rest, bins, number = [], None, None, 0
    while True:
        packed = _round(items, tasks, capacity, number, tasks == 1)
        if rest is not None and packed.select("sequence_id").distinct().count() >= bins:
            break
        done.append(packed.where("kept"))
        rest = packed.where("not kept")
        count, bins = rest.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if tasks == 1 or not count:
            break
        items, number = rest.drop("sequence_id", "offset", "kept", "gap"), number + 1
        tasks = -(-count // PIECES_PER_TASK)
    return reduce(DataFrame.unionByName, [*done, rest]).drop("kept", "place")


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(stored(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
