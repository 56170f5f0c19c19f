"""Words of whole Arrow text columns and their 64-bit hashes, computed on byte buffers without a loop per word.

Both word rules of this package separate words by ASCII bytes only, so UTF-8 can be cut bytewise: a byte of a
multi-byte character is never a separator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing).
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


@dataclass
class Words:
    """Word `i` is `data[start[i]:end[i]]` and belongs to row `doc[i]`; words of row r are `first[r]` to `first[r + 1]`."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another and the row borders; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = 2_000_000, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, one longer row alone, and at most `rows` rows, so that scratch arrays stay small."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    begin, used = 0, 0
    for i, n in enumerate(size):
        if used and used + n > limit or i - begin >= rows:
            yield begin, i
            begin, used = i, 0
        used += int(n)
    if len(size):
        yield begin, len(size)


def cut(texts: pa.Array, separators: np.ndarray, lower: bool = False) -> Words:
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, doc, first)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 21)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    length = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * down[start] + length)


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.start, words.end)


def run_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (borders between rows are not looked at)."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    size = len(word) - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += mix(word[k : k + size] + _PLACE[k % 64]) * _PLACE[(k * 7 + 1) % 64]
    return mix(out + np.uint64(n))
