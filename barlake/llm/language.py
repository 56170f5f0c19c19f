"""Language identification with bit-sliced Bloom filters over character trigrams.

Training counts trigrams of lower-case letters (with word borders) per language over all training rows and gives a
trigram the bits of every language in which its rate is at least `share` of its highest rate. The number of slots
follows from the language with the most trigrams, so that a strange trigram hits with a chance of `FALSE` at most; each
slot has one bit per language, so one read of `HASHES` slots and one AND give all languages that contain a trigram. A
document's score for a language is the number of its trigrams with that bit, corrected for the false positives expected
from the fill of the language's slice.

A filter above `BROADCAST_BYTES` is not built: the chosen trigrams stay a stored table, and the trigrams of the documents
are joined with it. Its hits are exact, so nothing is corrected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import columns, stored
from barlake.llm.tokens import batches as parts
from barlake.llm.words import mix

#: Fewest slots of a filter.
SLOTS = 1 << 19
HASHES = 3
BLOCK = 1 << 13
#: Highest chance that a strange trigram hits, and bytes of the largest filter that is sent to the executors.
FALSE = 0.001
BROADCAST_BYTES = 1 << 27


@lru_cache(None)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the first two planes, 0 for the rest."""
    out = np.zeros(0x20000, np.uint32)
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@dataclass
class Grams:
    """Distinct trigram codes of some texts, and for each occurrence its place among them and its text."""

    codes: np.ndarray
    which: np.ndarray
    text: np.ndarray


def grams(texts: list[str]) -> Grams:
    table = _letters()
    data = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), length + (np.arange(len(texts)) < len(texts) - 1))
    chars = np.where(data < len(table), table[np.minimum(data, len(table) - 1)], 0)
    keep = chars > 0
    keep[1:] |= chars[:-1] > 0
    chars, row = np.concatenate([[0], chars[keep], [0]]).astype(np.uint32), np.concatenate([[0], row[keep], [0]])
    if len(chars) < 3:
        return Grams(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    inside = chars[1:-1] > 0
    alphabet, small = np.unique(chars, return_inverse=True)
    k = len(alphabet)
    key = (small[:-2] * k + small[1:-1]) * k + small[2:]
    key, text = key[inside], row[1:-1][inside]
    if k <= 200:
        seen = np.bincount(key, minlength=1) > 0
        distinct = np.flatnonzero(seen)
        which = (np.cumsum(seen) - 1)[key]
    else:
        distinct, which = np.unique(key, return_inverse=True)
    wide = alphabet.astype(np.uint64)
    codes = wide[distinct // (k * k)] << np.uint64(42) | wide[distinct // k % k] << np.uint64(21) | wide[distinct % k]
    return Grams(codes, which, text)


def slots_for(grams: int) -> int:
    """Slots, a power of two, of a filter that holds `grams` trigrams in its fullest language."""
    need = -HASHES * grams / math.log1p(-(FALSE ** (1 / HASHES)))
    return max(SLOTS, 1 << math.ceil(math.log2(max(1.0, need))))


def slots_of(codes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """HASHES slots per code."""
    h = mix(codes + np.uint64(0x9E3779B97F4A7C15))
    step = mix(h) | np.uint64(1)
    return np.stack([((h + step * np.uint64(i)) >> np.uint64(7)) % np.uint64(slots) for i in range(HASHES)]).astype(np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """Occurrences of each trigram per language: summed within each task before they are shuffled."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            names, lang = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            for a, b in parts(texts, 2_000_000):
                g = grams(texts[a:b])
                own = lang[a:b][g.text]
                for k in np.unique(own):
                    n = np.bincount(g.which[own == k], minlength=len(g.codes))
                    seen = n > 0
                    codes, old = total.get(names[k], (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    merged, at = np.unique(np.concatenate([codes, g.codes[seen]]), return_inverse=True)
                    total[names[k]] = (merged, np.bincount(at, np.concatenate([old, n[seen]])).astype(np.int64))
        for name, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array([name] * len(codes)), pa.array(n)], ["gram", "lang", "n"])

    found = rows.select("text", "lang").mapInArrow(counts, "gram long, lang string, n long")
    return found.groupBy("gram", "lang").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    """`masks[slot]` holds the bits of `langs` in 64-bit words; `false` is the chance that a strange trigram hits."""

    langs: list[str]
    masks: np.ndarray
    false: np.ndarray
    prior: np.ndarray


@dataclass
class Table:
    """The languages of every trigram in full: `chosen` has one row of gram and lang each."""

    langs: list[str]
    chosen: DataFrame
    prior: np.ndarray


def train(rows: DataFrame, share: float = 0.3) -> Filter | Table:
    """Filter from the rows' text and lang; rows without either teach nothing.

    What reaches the driver is two counts per language and the filter itself, BROADCAST_BYTES at most.
    """
    counts = stored(count_grams(rows.where("text is not null and lang is not null")), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known = sorted((r["lang"], r["total"]) for r in totals.collect())
    langs = [k for k, _ in known]
    rates = counts.join(totals, "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("rate"))
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    chosen = stored(rates.join(most, "gram").where(F.col("rate") >= share * F.col("most")).select("gram", "lang"), "chosen")
    prior = np.array([n for _, n in known], float)
    slots = slots_for(max((r["count"] for r in chosen.groupBy("lang").count().collect()), default=0))
    words = -(-max(1, len(langs)) // 64)
    if slots * words * 8 > BROADCAST_BYTES:
        return Table(langs, chosen, prior)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = slots_of(batch.column(0).to_numpy().astype(np.uint64), slots).ravel()
            lang = batch.column(1).to_pylist() * HASHES
            yield pa.RecordBatch.from_arrays([pa.array(slot // BLOCK), pa.array(lang, pa.string()), pa.array(slot % BLOCK)], ["block", "lang", "slot"])

    def pack(key, group):
        bits = np.zeros(BLOCK, np.uint8)
        bits[group["slot"].to_numpy()] = 1
        group = group.iloc[:1].assign(bits=[np.packbits(bits).tobytes()])
        return group[["block", "lang", "bits"]]

    slices = chosen.mapInArrow(spots, "block long, lang string, slot long").distinct()
    slices = slices.groupBy("block", "lang").applyInPandas(pack, "block long, lang string, bits binary")
    masks = np.zeros((slots, words), np.uint64)
    fill = np.zeros(len(langs))
    place = {k: i for i, k in enumerate(langs)}
    for r in slices.toLocalIterator():
        i, bits = place[r["lang"]], np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8)).astype(np.uint64)
        masks[r["block"] * BLOCK : (r["block"] + 1) * BLOCK, i // 64] |= bits << np.uint64(i % 64)
        fill[i] += bits.sum()
    return Filter(langs, masks, (fill / slots) ** HASHES, prior)


def _hits(g: Grams, texts: int, f: Filter) -> np.ndarray:
    hits = np.zeros((texts, len(f.langs)))
    if len(g.codes) and f.langs:
        spots = slots_of(g.codes, len(f.masks))
        masks = f.masks[spots[0]]
        for s in spots[1:]:
            masks = masks & f.masks[s]
        for i in range(len(f.langs)):
            has = (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
            hits[:, i] = np.bincount(g.text[has[g.which]], minlength=texts)
    return hits


def _judge(hits: np.ndarray, n: np.ndarray, lettered: list[bool], langs: list[str], false: np.ndarray, prior: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of texts with `n` trigrams each; `und` for those without letters."""
    corrected = np.maximum(0.0, (hits - n[:, None] * false) / np.maximum(1e-9, 1 - false))
    pred, score = [], []
    for own, some in zip(corrected, lettered):
        if not langs or not some:
            pred.append("und")
            score.append(0.0)
            continue
        best = int(own.argmax()) if own.any() else int(prior.argmax())
        pred.append(langs[best])
        score.append(float(own[best] / own.sum()) if own.any() else 0.0)
    return pred, score


def _lettered(texts: list[str], n: np.ndarray) -> list[bool]:
    return [bool(k) or any(map(str.isalpha, t)) for t, k in zip(texts, n)]


def _scores(texts: list[str], f: Filter) -> tuple[list[str], list[float]]:
    g = grams(texts)
    n = np.bincount(g.text, minlength=len(texts)).astype(float)
    return _judge(_hits(g, len(texts), f), n, _lettered(texts, n), f.langs, f.false, f.prior)


def _looked_up(docs: DataFrame, model: Table) -> DataFrame:
    """As `identify`, by a join of each row's distinct trigrams with the table; frequent ones are split by adaptive skew handling."""
    langs, prior = model.langs, model.prior
    place = {k: i for i, k in enumerate(langs)}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in parts(texts, 500_000):
                g = grams(texts[a:b])
                k = max(1, len(g.codes))
                pair, times = np.unique(g.text * k + g.which, return_counts=True)
                cuts = np.searchsorted(pair, np.arange(b - a + 1) * k)
                n = np.bincount(g.text, minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + b - a)), keys.slice(a, b - a), pa.array(n), pa.array(_lettered(texts[a:b], n), pa.bool_()),
                        pa.LargeListArray.from_arrays(cuts, g.codes[pair % k].astype(np.int64) if len(pair) else pa.array([], pa.int64())).cast(pa.list_(pa.int64())),
                        pa.LargeListArray.from_arrays(cuts, times).cast(pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "n", "lettered", "grams", "times"],
                )
                row += b - a

    made = docs.mapInArrow(split, "row long, doc_id long, n long, lettered boolean, grams array<long>, times array<long>")
    # Stored, so that a row keeps its number in both uses.
    rows = stored(made, "grams")
    each = rows.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.times").alias("times"))
    hits = each.join(model.chosen, "gram").groupBy("row", "lang").agg(F.sum("times").alias("n"))
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("lang", "n")).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, len(langs)))
            for i, own in enumerate(batch.column(3).to_pylist()):
                for hit in own or ():
                    found[i, place[hit["lang"]]] = hit["n"]
            n = batch.column(1).to_numpy().astype(float)
            pred, score = _judge(found, n, batch.column(2).to_pylist(), langs, np.zeros(len(langs)), prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    joined = rows.select("row", "doc_id", "n", "lettered").join(hits, "row", "left").select("doc_id", "n", "lettered", "hits")
    return joined.mapInArrow(judge, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, model: Filter | Table) -> DataFrame:
    """`lang_pred` and `score` of every row, from its whole text alone; `und` without letters or text."""
    if isinstance(model, Table):
        return _looked_up(columns(docs, "doc_id", "text"), model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pred, score = [t or "" for t in batch.column(1).to_pylist()], [], []
            for a, b in parts(texts, 2_000_000):
                p, s = _scores(texts[a:b], shared.value)
                pred += p
                score += s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return columns(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")
