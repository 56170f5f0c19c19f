"""Benchmark decontamination with suffix arrays over the training texts.

Every task cuts its documents into shards of a few megabytes and builds a suffix array over the words of each; all
test suffixes are looked up in it by binary search. A suffix that starts with a whole window (13 words, or a shorter
item as a whole) gives an interval of the array: all verbatim occurrences with their places, from which matches are
followed to their full length. Words of a shard that lie in no short run of words of the benchmark cannot be part of
an occurrence and are left out before sorting, so a shard's array holds candidates only.

The benchmark goes to the tasks in blocks of at most BLOCK_BYTES of text; a larger benchmark means more blocks, each
run over the same shard in turn. Documents are not shuffled and one document's hits never leave its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barlake.llm.common import columns, release
from barlake.llm.words import NON_ALNUM, cut, run_hashes, slices, word_hashes

WINDOW = 13
BLOCK_BYTES = 16_000_000
SEED_WORDS = 6
SIEVE_BITS = 22


@dataclass
class Block:
    """Some items: distinct word hashes, the items' words as places among them (from 1), 0 after each item."""

    vocabulary: np.ndarray
    text: np.ndarray
    suffix: np.ndarray
    need: np.ndarray
    left: np.ndarray
    item: np.ndarray
    ids: list
    seed: int
    seeds: np.ndarray
    longest: int


def block(ids: list, texts: list[str]) -> Block | None:
    """Index of items with words; None if there are none."""
    words = cut(pa.array(texts, pa.large_string()), NON_ALNUM, lower=True)
    sizes = np.diff(words.first)
    if not sizes.any():
        return None
    h = word_hashes(words)
    vocabulary = np.unique(h)
    text = np.zeros(len(h) + len(sizes), np.int64)
    at = np.arange(len(h)) + words.doc
    text[at] = np.searchsorted(vocabulary, h) + 1
    left = words.first[words.doc + 1] - np.arange(len(h))
    need = np.minimum(sizes, WINDOW)[words.doc]
    whole = left >= need
    seed = int(min(SEED_WORDS, sizes[sizes > 0].min()))
    runs = run_hashes(h, seed)
    inside = words.doc[: len(runs)] == words.doc[seed - 1 : seed - 1 + len(runs)]
    return Block(vocabulary, text, at[whole], need[whole], left[whole], words.doc[whole], ids, seed, np.unique(runs[inside]), int(sizes.max()))


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    ids, texts, used = [], [], 0
    for row in columns(benchmark, "item_id", "text").where("text is not null").toLocalIterator():
        if used and used + len(row["text"]) > limit:
            if made := block(ids, texts):
                yield made
            ids, texts, used = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        used += len(row["text"])
    if texts and (made := block(ids, texts)):
        yield made


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in order of their first `depth` words, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1]
    k, n = 1, len(text)
    while k < depth and len(rank) and rank.max() < n - 1:
        follow = np.zeros(n, np.int64)
        follow[: n - k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1]
        k *= 2
    return np.argsort(rank, kind="stable")


def search(text: np.ndarray, array: np.ndarray, test: np.ndarray, start: np.ndarray, need: np.ndarray, after: bool) -> np.ndarray:
    """First place in the array whose suffix is not below the test suffix (`after`: is above it), on `need` words."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    padded = np.append(text, np.zeros(int(need.max(initial=1)), np.int64))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        at, order = array[mid], np.zeros(len(open_), np.int64)
        for k in range(int(need[open_].max())):
            live = np.flatnonzero((order == 0) & (need[open_] > k))
            if not live.size:
                break
            order[live] = np.sign(padded[at[live] + k] - test[start[open_[live]] + k])
        right = order <= 0 if after else order < 0
        low[open_] = np.where(right, mid + 1, low[open_])
        high[open_] = np.where(right, high[open_], mid)
    return low


def occurrences(words, hashes: np.ndarray, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word place, window size, full length and item of every occurrence of a window of the block in the shard."""
    none = (np.zeros(0, np.int64),) * 4
    runs = run_hashes(hashes, b.seed)
    if not len(runs):
        return none
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    low_bits = np.uint64((1 << SIEVE_BITS) - 1)
    sieve[b.seeds & low_bits] = True
    some = np.flatnonzero(sieve[runs & low_bits])
    some = some[words.doc[some] == words.doc[some + b.seed - 1]]
    some = some[b.seeds[np.minimum(np.searchsorted(b.seeds, runs[some]), len(b.seeds) - 1)] == runs[some]]
    if not len(some):
        return none
    covered = np.zeros(len(hashes), bool)
    for k in range(b.seed):
        covered[some + k] = True
    place = np.flatnonzero(covered)
    apart = np.ones(len(place), bool)
    apart[1:] = (np.diff(place) > 1) | (words.doc[place[1:]] != words.doc[place[:-1]])
    at = np.arange(len(place)) + np.cumsum(apart)
    text = np.zeros(at[-1] + 2, np.int64)
    text[at] = np.searchsorted(b.vocabulary, hashes[place]) + 1
    origin = np.zeros(len(text), np.int64)
    origin[at] = place
    array = suffix_array(text, b.longest)
    first = search(text, array, b.text, b.suffix, b.need, False)
    last = search(text, array, b.text, b.suffix, b.need, True)
    found = np.flatnonzero(last > first)
    count = (last - first)[found]
    which = np.repeat(found, count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    start = array[np.repeat(first[found], count) + inside]
    length = b.need[which].copy()
    grow = np.arange(len(which))
    while grow.size:
        n = length[grow]
        grow = grow[(n < b.left[which[grow]]) & (text[np.minimum(start[grow] + n, len(text) - 1)] == b.text[b.suffix[which[grow]] + n])]
        length[grow] += 1
    return origin[start], b.need[which], length, b.item[which]


@dataclass
class Hits:
    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[set]
    longest: list[tuple[int, int, int]]

    def contaminated(self) -> np.ndarray:
        return (self.n_hit > 0) & (20 * self.n_hit >= self.n_words)


def scan(texts: pa.Array, shared: list) -> Iterator[tuple[int, int, Hits]]:
    for a, b in slices(texts):
        words = cut(texts.slice(a, b - a), NON_ALNUM, lower=True)
        hashes = word_hashes(words)
        step = np.zeros(len(hashes) + 1, np.int64)
        items: list[set] = [set() for _ in range(b - a)]
        longest = [(0, -1, -1)] * (b - a)
        for variable in shared:
            own = variable.value
            place, window, length, item = occurrences(words, hashes, own)
            np.add.at(step, place, 1)
            np.add.at(step, place + window, -1)
            docs = words.doc[place]
            if len(docs):
                pairs = np.unique(docs * (len(own.ids) + 1) + item)
                for d, i in zip((pairs // (len(own.ids) + 1)).tolist(), (pairs % (len(own.ids) + 1)).tolist()):
                    items[d].add("" if own.ids[i] is None else str(own.ids[i]))
                order = np.lexsort((place, -length, docs))
                for k in order[np.unique(docs[order], return_index=True)[1]]:
                    d = int(docs[k])
                    if length[k] > longest[d][0]:
                        longest[d] = (int(length[k]), int(place[k] - words.first[d]), int(item[k]))
            if len(shared) > 1 and hasattr(variable, "_value"):
                del variable._value
        hit = np.cumsum(step[:-1]) > 0
        yield a, b, Hits(np.diff(words.first), np.bincount(words.doc[hit], minlength=b - a), items, longest)


def _shared(benchmark: DataFrame) -> list:
    return [benchmark.sparkSession.sparkContext.broadcast(b) for b in blocks(benchmark)]


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs`: words, words hit, items found, and length and word place of the longest match.

    Null texts have no words on either side. An item that stands twice counts once per item_id.
    """
    shared = _shared(benchmark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hits in scan(batch.column(1), shared):
                digest = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in hits.items]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(hits.n_words, pa.int64()), pa.array(hits.n_hit, pa.int64()), pa.array([len(s) for s in hits.items], pa.int64()),
                        pa.array(digest), pa.array(hits.contaminated()), pa.array([n for n, _, _ in hits.longest], pa.int64()),
                        pa.array([p if p >= 0 else None for _, p, _ in hits.longest], pa.int64()),
                    ],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return columns(docs, "doc_id", "text").mapInArrow(rows, SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, all columns as they are, without a shuffle."""
    shared, at = _shared(benchmark), docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hits in scan(batch.column(at), shared):
                yield batch.slice(a, b - a).filter(pa.array(~hits.contaminated()))
        release()

    return docs.mapInArrow(rows, docs.schema)
