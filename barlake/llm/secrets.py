"""Secret scan: fixed patterns and a token-efficiency test over every whole text.

Four kinds of spans, in code points with exclusive ends:

    assign  a key name, a separator and a value of 6 or more characters
    access  AKIA and 16 or more capitals or digits
    hex     24 or more lowercase hexadecimal digits
    random  a run of 16 or more of `[A-Za-z0-9+/_=-]` with letters whose characters per token under a byte-level
            vocabulary are few; known digests (hexadecimal of a digest's length), UUIDs and dates are not tested.
            Runs without a digit, paths, and words with numbers at an end are measured by their parts of three or
            more letters, so that separators and numbers do not make words look random

The first three find leftmost matches that do not overlap within a kind; matches that are too short are dropped and
do not make room for others inside them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barlake.llm import tokens
from barlake.llm.common import columns

KINDS = ("assign", "access", "hex", "random")
# The patterns of the base scan.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Digests in hexadecimal (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), UUIDs, time stamps.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})"
    r"|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|[0-9][0-9T_-]*"
)
#: Words and paths with numbers.
WORDS = re.compile(
    r"(?:[/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))(?:[/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[/_=-]*"
    r"|[A-Za-z]+[0-9]+"
)
PART = re.compile(r"[A-Za-z]{3,}")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def base_spans(text: str, folded: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed kinds; `folded` is the text in lower-case bytes, for a quick test."""
    found = []
    if any(n in folded for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in folded:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, encode, most: float) -> list[tuple[int, int, int]]:
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if not any(c.isalpha() for c in run) or KNOWN.fullmatch(run):
            continue
        tested = [run]
        if (words := WORDS.fullmatch(run)) or not any(c.isdigit() for c in run):
            tested = PART.findall(run) or ([] if words else tested)
        if sum(map(len, tested)) < most * sum(len(encode(t)) for t in tested):
            found.append((m.start(), 3, m.end()))
    return found


def secrets(docs: DataFrame, vocabulary: str | None = None, most: float = 2.0) -> DataFrame:
    """One row per row of `docs`: counts per kind, a digest of the base spans, and all spans as text.

    Null text counts as empty. `most`: runs with fewer characters per token are random.
    """
    vocabulary = vocabulary or tokens.vocabulary("byte_bpe_50k.tiktoken")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.rank_encoding(vocabulary).encode_ordinary
        for batch in batches:
            out = [[] for _ in _NAMES]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                base = base_spans(text, text.encode().lower())
                spans = sorted(base + random_spans(text, encode, most))
                shown = lambda s: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s)
                kinds = [k for _, k, _ in spans]
                row = (key, *[kinds.count(k) for k in range(4)], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], _NAMES)

    return columns(docs, "doc_id", "text").mapInArrow(rows, SCHEMA)
