"""Cross-tokenizer alignment: byte ends of two tokenisations merged in equal pieces along merge-path diagonals.

A document's tokens under A and B cover the same bytes, so each side is an ascending list of end offsets, and the
documents of a task follow each other in one long pair of lists. Merging two sorted lists is a path through a grid; the
point where it crosses a diagonal i + j = d is found by binary search without merging what comes before. Diagonals at
equal distances cut the path into pieces of equal work that are merged independently, whatever the documents' lengths:
a long document is many pieces, many short ones are one. A common end is never cut apart.

1. **Pieces.** Each task encodes its texts and yields one row per piece: token ids of both sides and the borders of
   documents in it.
2. **Merge.** Each piece yields its common ends (links), its part of every document's groups, and its distinct id pairs
   with their counts: one stored row, without token ids but for documents that the piece cuts.
3. **Counts.** Pairs are summed over the corpus, the best A id of every B id is marked, and each piece hears of its own
   distinct pairs only; no table of pairs is broadcast.
4. **Stitch.** Documents inside one piece are finished there. Parts of documents that cross pieces are joined: the tokens
   after the last common end of one piece open the first group of the next.

Distinct words with the white space before them are encoded once per worker: no piece of either vocabulary runs from
another character into a space, and none of B holds other ASCII white space than \\r. Texts with \\r or white space
outside ASCII are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import columns, release, stored
from barlake.llm.tokens import WordStore, bounds, chunks, distinct, in_order, odd_texts, split_ids
from barlake.llm.words import slices

#: Merge steps of a piece, text bytes that a task encodes at once, and words kept by a worker.
WORK, SLICE_BYTES, WORDS = 1_000_000, 3_000_000, 300_000
#: Words encoded in one call, B in fewer as its work grows with the length of a text.
LOT, LOT_B = 1_000, 100


class Vocabularies:
    """Both encoders, the bytes of every token, and the words encoded so far."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        named = self.a.get_vocab()
        self.bytes_a = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = pieces.index("▁")
        self.size_a, self.size_b = (np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.store = WordStore(self._encode, 3, WORDS)
        # Ids of A are in the order of its merges, so they are ranks for the faster library too; used for ASCII only.
        base = self.a.get_vocab(with_added_tokens=False)
        ranks = {self.bytes_a[i]: i for i in base.values()}
        self.ranked = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if _in_order(path_a, base) else None

    def _checked(self, text: bytes, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Ids of both sides and none of the third, or one id of the third side where their bytes are not the text's."""
        if b"".join([self.bytes_a[i] for i in a]) != text or b"".join([self.bytes_b[i] for i in b]) != text:
            return [], [], [0]
        return a, b, []

    def _alone(self, chunk: bytes) -> tuple[list[int], list[int], list[int]]:
        """A chunk encoded on its own. B puts a space before what it is given: that of the chunk, or one that is taken off again."""
        text = chunk.decode()
        if text == " ":
            b = [self.space]  # nothing is given, so nothing is put before it
        elif text[0] == " ":
            b = self.b.encode(text[1:])
        else:
            b = self.b.encode(text)
            b = b[1:] if b and b[0] == self.space else [0]
        return self._checked(chunk, self.a.encode(text, add_special_tokens=False).ids, b)

    def _side_a(self, text: str) -> list[int]:
        if self.ranked and text.isascii():
            return self.ranked.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, chunks: list[bytes]):
        # a word with a space before it joins others; B's sign for a space, odd white space and ends of texts stand alone
        join = [c[:1] == b" " and not c.isspace() and not ODD.search(c.decode()) for c in chunks]
        parts: list[list] = [[], [], []]
        order: list[int] = []
        for ascii_ in (True, False):
            own = [i for i, (c, j) in enumerate(zip(chunks, join)) if j and c.isascii() == ascii_]
            for at in range(0, len(own), LOT):
                lot = own[at : at + LOT]
                joined = b"".join([chunks[i] for i in lot])
                lengths = [len(chunks[i]) for i in lot]
                ids_a = self._side_a(joined.decode())
                ids_b = [i for k in range(0, len(lot), LOT_B) for i in self.b.encode(b"".join([chunks[i] for i in lot[k : k + LOT_B]])[1:].decode())]
                if self._checked(joined, ids_a, ids_b)[2]:
                    raise ValueError("words encoded together do not give back their bytes")
                parts[0].append(split_ids(np.array(ids_a, np.uint32), self.size_a, lengths))
                parts[1].append(split_ids(np.array(ids_b, np.uint32), self.size_b, lengths))
                parts[2].append((np.zeros(0, np.uint32), np.zeros(len(lot), np.int64)))
                order += lot
        rest = [i for i, j in enumerate(join) if not j]
        alone = [self._alone(chunks[i]) for i in rest]
        for side in range(3):
            parts[side].append((np.array([x for own in alone for x in own[side]], np.uint32), np.array([len(own[side]) for own in alone], np.int64)))
        return [in_order(p, order + rest) for p in parts]

    def ids(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of all texts, each with a space before it, and the borders of texts; a text without tokens has none."""
        texts = texts.cast(pa.string()).fill_null("")
        some = pc.not_equal(texts, "")
        spaced = pc.if_else(some, pc.binary_join_element_wise(" ", texts, ""), "")
        whole = odd_texts(texts) | pc.match_substring(texts, "\r").to_numpy(zero_copy_only=False)
        column, first = chunks(spaced, whole)
        names, codes = distinct(column)
        places = self.store.places(names)[codes]
        bad = bounds(self.store.ids(2, places)[1], first)
        lost = np.repeat(np.diff(bad) > 0, np.diff(first))
        out = []
        for side in (0, 1):
            # texts that are not given back have no words
            ids, size = self.store.ids(side, places[~lost])
            all_sizes = np.zeros(len(places), np.int64)
            all_sizes[~lost] = size
            out.append((ids, bounds(all_sizes, first)))
        return out


#: White space that the libraries' patterns may treat differently, and B's sign for a space.
ODD = re.compile("[\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")


def _in_order(path: str, ids: dict[str, int]) -> bool:
    """Whether every merge of a vocabulary file gives a larger id than the merge before it."""
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    return all(a < b for a, b in zip(made, made[1:]))


@lru_cache(1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of `a` lie on the merge path of two ascending lists before each diagonal i + j = d.

    Binary search over i on all diagonals at once: a[i] comes before b[d - i - 1] if it is not larger. Where a diagonal
    falls between two equal ends, the end of `b` is taken along by the caller (see `cuts`).
    """
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        open_ = low < high
        i = (low + high) // 2
        before = np.zeros(len(i), bool)
        before[open_] = a[i[open_]] <= b[diagonals[open_] - i[open_] - 1]
        low, high = np.where(open_ & before, i + 1, low), np.where(open_ & ~before, i, high)
    return low


def cuts(a: np.ndarray, b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """Borders (i, j) of pieces of `work` merge steps each; equal ends stay in one piece."""
    total = len(a) + len(b)
    diagonals = np.arange(work, total, work)
    i = merge_path(a, b, diagonals) if len(diagonals) else diagonals
    out = [(0, 0)]
    for x, y in zip(i.tolist(), (diagonals - i).tolist()):
        if x and y < len(b) and a[x - 1] == b[y]:
            y += 1
        if (x, y) != out[-1]:
            out.append((x, y))
    if out[-1] != (len(a), len(b)):
        out.append((len(a), len(b)))
    return out


#: Rows of the table of documents in a piece: number, tokens of A and B in the piece, begun before it, going on after it.
NUMBER, TOKENS_A, TOKENS_B, BEFORE, AFTER = range(5)


def _narrow(count: int) -> str:
    return "<u2" if count <= 1 << 16 else "<u4"


def pieces(batches: Iterator[pa.RecordBatch], words: Vocabularies, work: int, number: int) -> Iterator[dict]:
    """Pieces of a task's rows (doc_id, text): documents, token ids, and the byte offsets at which both sides begin."""
    sizes = words.size_a, words.size_b
    before = number  # documents so far, numbered per task
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for first, last in slices(batch.column(1), SLICE_BYTES):
            both = words.ids(batch.column(1).slice(first, last - first))
            flat, until = [ids for ids, _ in both], [at[1:] for _, at in both]
            ends = [np.cumsum(size[x]) for size, x in zip(sizes, flat)]
            for docs, spans in _cut_documents(until, cuts(ends[0], ends[1], work)):
                piece = {"piece": number, "keys": [keys[first + k] for k in docs[NUMBER]]}
                docs[NUMBER] += before
                piece["docs"] = docs
                for side, (i, x), ids, end in zip("ab", spans, flat, ends):
                    piece[f"ids_{side}"], piece[f"start_{side}"] = ids[i:x], int(end[i - 1]) if i else 0
                yield piece
                number += 1
            before += last - first


def _cut_documents(until: list[np.ndarray], borders: list[tuple[int, int]]):
    """For each piece the table of its documents, and its span on either side. `until`: tokens up to each document's end."""
    count, at = len(until[0]), 0
    begin = [np.concatenate([[0], u[:-1]]) for u in until]
    if len(borders) == 1:
        borders = borders * 2
    for (i, j), (x, y) in zip(borders, borders[1:]):
        last = (x, y) == borders[-1]
        done = count if last else max(at, int(min(np.searchsorted(until[0], x, "right"), np.searchsorted(until[1], y, "right"))))
        own = np.arange(at, min(done + 1, count))
        tokens = [np.clip(u[own], low, high) - np.clip(b[own], low, high) for u, b, low, high in zip(until, begin, (i, j), (x, y))]
        table = np.stack([own, *tokens, (begin[0][own] < i) | (begin[1][own] < j), own >= done]).astype(np.int64)
        # the next document is no part of this piece if none of its tokens is
        yield table[:, (own < done) | (tokens[0] + tokens[1] > 0)], ((i, x), (j, y))
        at = done


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places on either side of the ends that both sides have."""
    place = np.searchsorted(ends_b, ends_a)
    hit = place < len(ends_b)
    hit[hit] = ends_b[place[hit]] == ends_a[hit]
    return np.flatnonzero(hit), place[hit]


@lru_cache(4)
def _names(size: int) -> list[bytes]:
    """Decimal ids with the separator after a token that is not its group's last, then with that after the last one, A then B."""
    return [b"%d%s" % (i, mark) for mark in (b",", b"|", b",", b";") for i in range(size)]


def group_names(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, size: int) -> list[bytes]:
    """Tokens in the order of their groups, A before B, each with its separator; last_a and last_b are the common ends."""
    group_a, group_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
    after_a, after_b = np.append(last_a + 1, len(ids_a)), np.concatenate([[0], last_b + 1])
    code = np.zeros(len(ids_a) + len(ids_b), np.int64)
    own_a, own_b = ids_a.astype(np.int64), ids_b.astype(np.int64) + 2 * size
    own_a[last_a] += size
    own_b[last_b] += size
    code[np.arange(len(ids_a)) + after_b[group_a]] = own_a
    code[np.arange(len(ids_b)) + after_a[group_b]] = own_b
    names = _names(size)
    return [names[c] for c in code.tolist()]


def _sha(names: list[bytes]) -> str:
    """Digest of a document's groups; without tokens the empty text, not hashed."""
    return hashlib.sha256(b"".join(names)[:-1]).hexdigest() if names else ""


MERGED = (
    "kind int, piece long, docs binary, keys array<long>, links binary, shas array<string>, pairs binary, counts binary, link_pairs binary, "
    "number long, ids_a binary, ids_b binary, last_a binary, last_b binary"
)


def _merge(piece: dict, words: Vocabularies) -> list[dict]:
    """Links, groups and distinct id pairs of one piece (kind 0), and the parts of documents that it cuts (kind 1)."""
    size, width = max(len(words.size_a), len(words.size_b)), len(words.size_b)
    ids_a, ids_b, docs = piece["ids_a"], piece["ids_b"], piece["docs"]
    last_a, last_b = common_ends(piece["start_a"] + np.cumsum(words.size_a[ids_a]), piece["start_b"] + np.cumsum(words.size_b[ids_b]))
    until_a, until_b = np.cumsum(docs[TOKENS_A]), np.cumsum(docs[TOKENS_B])
    links = np.diff(np.searchsorted(last_a, until_a), prepend=0)
    names = group_names(ids_a, ids_b, last_a, last_b, size)
    whole = (docs[BEFORE] == 0) & (docs[AFTER] == 0)
    upto = np.concatenate([[0], until_a + until_b]).tolist()
    shas = [_sha(names[s:e]) if w else None for w, s, e in zip(whole, upto, upto[1:])]
    pairs, place, counts = np.unique(ids_a[last_a].astype(np.int64) * width + ids_b[last_b], return_inverse=True, return_counts=True)
    out = [{
        "kind": 0, "piece": piece["piece"], "docs": docs.tobytes(), "keys": piece["keys"], "links": links.astype(np.int64).tobytes(), "shas": shas,
        "pairs": pairs.tobytes(), "counts": counts.astype(np.int64).tobytes(), "link_pairs": place.astype(_narrow(len(pairs))).tobytes(),
    }]
    for d in np.flatnonzero(~whole):
        (a0, a1), (b0, b1) = ((int(u[d] - docs[t, d]), int(u[d])) for u, t in ((until_a, TOKENS_A), (until_b, TOKENS_B)))
        k0, k1 = np.searchsorted(last_a, [a0, a1])
        out.append({
            "kind": 1, "piece": piece["piece"], "number": int(docs[NUMBER, d]), "ids_a": ids_a[a0:a1].tobytes(), "ids_b": ids_b[b0:b1].tobytes(),
            "last_a": (last_a[k0:k1] - a0).tobytes(), "last_b": (last_b[k0:k1] - b0).tobytes(),
        })
    return out


def merged(docs: DataFrame, path_a: str, path_b: str, work: int = WORK) -> DataFrame:
    """Pieces of all documents, each merged on its own; stored."""
    kinds = {"kind": pa.int32(), "piece": pa.int64(), "keys": pa.list_(pa.int64()), "shas": pa.list_(pa.string()), "number": pa.int64()}
    names = [c.split()[0] for c in MERGED.split(", ")]
    schema = pa.schema([(n, kinds.get(n, pa.binary())) for n in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies(path_a, path_b)
        try:
            for piece in pieces(batches, words, work, TaskContext.get().partitionId() << 32):
                yield pa.RecordBatch.from_pylist(_merge(piece, words), schema=schema)
        finally:  # workers are used again, and the next task may need the memory
            words.store.clear()
            release()

    return stored(columns(docs, "doc_id", "text").mapInArrow(rows, MERGED), "alignment-merged", "zstd")


def pair_counts(pieces_merged: DataFrame) -> DataFrame:
    """Rows (piece, pair, n): distinct pairs of each piece with their links in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                pairs, counts = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["counts"], np.int64)
                yield pa.RecordBatch.from_pydict({"piece": np.full(len(pairs), row["piece"], np.int64), "pair": pairs, "n": counts})

    return pieces_merged.where("kind = 0").select("piece", "pairs", "counts").mapInArrow(rows, "piece long, pair long, n long")


DOCUMENTS = "number long, doc_id long, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answered(piece: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of one piece with the corpus-wide counts of their links; a null digest marks a part of a document."""
    if not piece.num_rows:
        return pa.Table.from_pylist([], schema=_DOCUMENTS)
    row = piece.to_pylist()[0]
    docs, links = np.frombuffer(row["docs"], np.int64).reshape(5, -1), np.frombuffer(row["links"], np.int64)
    pair = answers["pair"].to_numpy()
    order = np.argsort(pair)
    assert np.array_equal(pair[order], np.frombuffer(row["pairs"], np.int64))
    place = np.frombuffer(row["link_pairs"], _narrow(len(pair)))
    upto = np.cumsum(links)
    sums = []
    for name in ("best", "total"):
        running = np.concatenate([[0], np.cumsum(answers[name].to_numpy()[order][place])])
        sums.append(running[upto] - running[upto - links])
    return pa.Table.from_arrays(
        [pa.array(docs[NUMBER]), pa.array(row["keys"], pa.int64()), pa.array(docs[TOKENS_A]), pa.array(docs[TOKENS_B]), pa.array(links), *map(pa.array, sums), pa.array(row["shas"], pa.string())],
        schema=_DOCUMENTS,
    )


_DOCUMENTS = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DOCUMENTS.split(", ")])


def _stitched(size: int):
    """Digest of a document from its parts: tokens after the last common end of a part belong to the next part's first group."""

    def stitch(parts: pa.Table) -> pa.Table:
        rows = sorted(parts.to_pylist(), key=lambda r: r["piece"])
        side = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
        out = []
        for s in "ab":
            ids, last = side(f"ids_{s}", "<u4"), side(f"last_{s}", np.int64)
            before = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            out.append((np.concatenate(ids), np.concatenate([x + b for x, b in zip(last, before)])))
        (ids_a, last_a), (ids_b, last_b) = out
        return pa.table({"number": pa.array([rows[0]["number"]]), "sha": [_sha(group_names(ids_a, ids_b, last_a, last_b, size))]})

    return stitch


def align(docs: DataFrame, path_a: str, path_b: str, work: int = WORK) -> DataFrame:
    """Groups and links of every row of documents under a byte-level vocabulary A and a piece vocabulary B.

    doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose id pair is as frequent as any pair of their B id),
    count_sum (corpus-wide link counts summed over the links) and groups_sha256. Null and empty texts, and texts that the
    vocabularies do not give back byte for byte, have no tokens: zeros and an empty digest. Repeated rows are counted as
    often as they stand; rows without doc_id keep a null doc_id. An empty table gives no rows.
    """
    words = vocabularies(path_a, path_b)
    size, width = max(len(words.size_a), len(words.size_b)), len(words.size_b)
    table = merged(docs, path_a, path_b, work)
    found = pair_counts(table)
    totals = found.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % width)
    totals = stored(totals, "alignment-pairs")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    known = totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    answers = found.select("piece", "pair").join(known, "pair")
    own = table.where("kind = 0").select("piece", "docs", "keys", "links", "shas", "pairs", "link_pairs")
    rows = stored(own.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(_answered, DOCUMENTS), "alignment-documents")
    whole = rows.where("groups_sha256 is not null").drop("number")
    parts = rows.where("groups_sha256 is null").groupBy("number").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_links", "n_best", "count_sum")])
    shas = table.where("kind = 1").select("number", "piece", "ids_a", "ids_b", "last_a", "last_b").groupBy("number").applyInArrow(_stitched(size), "number long, sha string")
    parts = parts.join(shas, "number").withColumn("groups_sha256", F.col("sha")).select(*whole.columns)
    both = whole.unionByName(parts)
    return both.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
