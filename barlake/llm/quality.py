"""Quality rules: counts of every whole text, then tokenizer fertility against bands per language or script.

Fertility is measured on words, each encoded once per worker: characters per token under two public vocabularies,
the share of byte-fallback tokens, and the entropy of the token ids. A document is rejected if

* characters per token leave the band of its language under both vocabularies, or
* any measure leaves the wide band of its script, or
* a base rule fails.

The band of a language is [Q1 - k IQR, Q3 + 3 k IQR] over the different measurements of all its documents, so copies
count once; below 200 words it is wider by the root of 200 / words, as means of few words scatter more. Many
characters per token are a milder sign than few, hence the larger upper reach. Languages with fewer than `least` different measurements, and documents without a language, have the
band of their script only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm import tokens
from barlake.llm.common import columns, release, stored
from barlake.llm.words import SPACE, buffers, cut, mix, run_hashes, slices, word_hashes


class Band(NamedTuple):
    """Accepted range of each measure, borders included; entropy in bits per token."""

    piece_chars: tuple[float, float] = (1.2, 6.5)
    byte_chars: tuple[float, float] = (1.0, 6.5)
    fallback: tuple[float, float] = (0.0, 0.2)
    entropy: tuple[float, float] = (3.0, 20.0)


#: Wide bands by script: any running text is inside; texts of digits, random strings or a few repeated words are not.
BANDS: dict[str, Band] = {
    "Latin": Band(),
    "Greek": Band(piece_chars=(0.6, 5.0), byte_chars=(0.4, 4.0), fallback=(0.0, 0.4)),
    "Cyrillic": Band(piece_chars=(0.9, 6.0), byte_chars=(0.4, 4.5), fallback=(0.0, 0.3)),
    "Arabic": Band(piece_chars=(0.5, 4.0), byte_chars=(0.3, 4.0), fallback=(0.0, 0.5)),
    "Han": Band(piece_chars=(0.3, 2.5), byte_chars=(0.2, 2.0), fallback=(0.0, 0.8)),
    "other": Band(piece_chars=(0.2, 6.5), byte_chars=(0.15, 6.5), fallback=(0.0, 1.0)),
}

#: First code points of ranges that decide the script of a letter.
_SCRIPTS = [(0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "other"), (0x600, "Arabic"), (0x780, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Han"), (0xAC00, "other")]
_STARTS = [c for c, _ in _SCRIPTS]


def script(text: str) -> str:
    """Script of most letters; `other` without letters."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "other"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = codes[((codes | 32) - 97 < 26) | (codes >= 0xC0)]
    if not len(letters):
        return "other"
    counts = np.bincount(np.searchsorted(_STARTS, letters, "right"), minlength=len(_STARTS) + 1)
    by = {}
    for (_, name), n in zip(_SCRIPTS, counts[1:].tolist()):
        by[name] = by.get(name, 0) + n
    return max(sorted(by), key=by.get)


@dataclass
class Rules:
    piece_vocabulary: str
    byte_vocabulary: str
    bands: dict[str, Band]
    fence: float = 2.0
    least: int = 50


def default_rules() -> Rules:
    return Rules(tokens.vocabulary("piece_bpe_32k.model"), tokens.vocabulary("byte_bpe_50k.tiktoken"), BANDS)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lang string, script string, piece_chars double, byte_chars double, fallback double, entropy double, base_failed boolean, in_script_band boolean"
)
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.float64()] * 4 + [pa.bool_()] * 2
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def repeated_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per row, and those inside three-word windows that occur twice or more in the row."""
    words = cut(texts, SPACE)
    count = np.diff(words.first)
    runs = run_hashes(word_hashes(words), 3)
    whole = words.doc[:-2] == words.doc[2:] if len(words.doc) > 2 else np.zeros(0, bool)
    keyed = mix(runs[: len(whole)] + words.doc[: len(whole)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(whole)
    order = at[np.argsort(keyed[at])]
    same = keyed[order[1:]] == keyed[order[:-1]]
    twice = np.zeros(len(words.doc), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return count, np.bincount(words.doc[covered], minlength=len(count))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive borders."""
    return np.diff(np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])[at])


def _entropy(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits per token of each text; 0 without tokens."""
    n = np.diff(at)
    key = np.sort(np.repeat(np.arange(len(n)), n) << 32 | ids.astype(np.int64))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, len(key))).astype(float)
    weighted = np.bincount(key[first] >> 32, count * np.log2(count), len(n))
    return np.where(n > 0, np.maximum(0.0, np.log2(np.maximum(n, 1)) - weighted / np.maximum(n, 1)), 0.0)


_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def measure(docs: DataFrame, rules: Rules | None = None, inner: int = 2_000_000) -> DataFrame:
    """One row of counts and measures per row of `docs`. Null text counts as no words."""
    rules = rules or default_rules()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens.piece_model(rules.piece_vocabulary)
        bytes_ = np.array([model.is_byte(i) for i in range(model.get_piece_size())], np.int64)
        store = tokens.pair_store(rules.piece_vocabulary, rules.byte_vocabulary)
        try:
            for batch in batches:
                for a, b in slices(batch.column(1), inner):
                    yield _rows(batch.slice(a, b - a), store, bytes_)
        finally:  # workers are used again, and the next task may need the memory
            store.clear()
            release()

    def _rows(part, store, bytes_):
        column = part.column(1).cast(pa.string()).fill_null("")
        n_words, n_repeat = repeated_words(column)
        data, at = buffers(column)
        chars = _sums((((data & 0xC0) != 0x80) & ~SPACE[data]).astype(np.int64), at)
        symbols = _sums(_SYMBOL[data], at)
        split = pc.ascii_split_whitespace(column)
        names, codes = tokens.distinct(split.flatten())
        places, first = store.places(names)[codes], split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        ids, sizes = store.ids(0, places)
        ids_at, ranks_at = tokens.bounds(sizes, first), tokens.bounds(store.ids(1, places)[1], first)
        n_ids, n_ranks = np.diff(ids_at), np.diff(ranks_at)
        per = lambda total, n: np.where(n > 0, total / np.maximum(n, 1), 0.0)
        measures = per(chars, n_ids), per(chars, n_ranks), per(_sums(bytes_[ids], ids_at), n_ids), _entropy(ids, ids_at)
        failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
        dups, kinds, inside = [], [], []
        for text, own in zip(column.to_pylist(), zip(*[m.tolist() for m in measures])):
            lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
            dups.append(len(lines) - len(set(lines)))
            kind = script(text)
            kinds.append(kind)
            inside.append(all(lo <= v <= hi for v, (lo, hi) in zip(own, rules.bands.get(kind) or rules.bands["other"])))
        out = [part.column(0), n_words, chars, symbols, dups, n_repeat, part.column(2), kinds, *measures, failed, inside]
        return pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(out, _TYPES)], _NAMES)

    return columns(docs, "doc_id", "text", "lang").mapInArrow(rows, SCHEMA)


def judged(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """`measure` with the bands of each language and the verdict `kept`.

    Every row is judged, repeated ones too. The measures are stored once; bands are a row per language.
    """
    rules = rules or default_rules()
    rows = stored(measure(docs, rules), "quality")
    fair = rows.where("not base_failed and in_script_band and lang is not null")
    fair = fair.select("lang", "piece_chars", "byte_chars").distinct()
    quarters = fair.groupBy("lang").agg(
        F.count("*").alias("_n"), *[F.percentile_approx(c, [0.25, 0.75], 10_000).alias(f"_{c}") for c in ("piece_chars", "byte_chars")]
    )
    outside = F.lit(True)
    for c in ("piece_chars", "byte_chars"):
        low, high = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        words = F.greatest(F.lit(1), F.col("n_words"))  # texts without words have failed, but Spark may compute this for them too
        reach = (high - low) * rules.fence * F.sqrt(F.greatest(F.lit(1.0), 200.0 / words))
        outside &= (F.col(c) < low - reach) | (F.col(c) > high + 3 * reach)
    verdict = ~F.col("base_failed") & F.col("in_script_band") & ~F.coalesce(outside, F.lit(False))
    bands = stored(quarters.where(F.col("_n") >= rules.least), "bands")  # of known size, so Spark sends small ones to the rows
    rows = rows.join(bands, "lang", "left")
    return rows.withColumn("kept", verdict).drop("_n", "_piece_chars", "_byte_chars")


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of `docs` whose verdict is `kept`, all columns as they are."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.col("lang"))
    verdicts = judged(docs.select(key.alias("doc_id"), "text", "lang"), rules)
    good = verdicts.where("kept").select(F.col("doc_id").alias("_key")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(whole, key.alias("_key")).join(good, "_key", "left_semi").select("_row.*")
