"""Token ids under public vocabularies, with each distinct word encoded once per worker.

The vocabularies below never merge across ASCII white space (see each function), so the ids of a text are those of
its pieces between white space. A worker keeps the ids of a bounded number of pieces; a full cache starts anew.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barlake.llm.words import SPACE, buffers, cut

#: Pieces kept per vocabulary and worker: about 200 bytes each. Vocabularies that are used side by side keep fewer.
CACHE_WORDS, CACHE_BESIDE = 300_000, 200_000


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Column:
    """A growing array."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(need, self.data.dtype)])
        self.data[self.used : need] = values
        self.used = need


class WordStore:
    """Ids of distinct byte strings in flat arrays, for one or more vocabularies.

    `encode(words)` gives (ids of all words, ids per word) for each vocabulary. A batch of texts is looked up once per
    distinct word and put together by array indexing. A full store keeps the words of the present batch.
    """

    def __init__(self, encode, sides: int, limit: int):
        self.encode, self.sides, self.limit = encode, sides, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.begin, self.size = ([_Column(kind) for _ in range(self.sides)] for kind in (np.uint32, np.int64, np.int64))

    def _add(self, words: list[bytes], encoded: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        for (ids, size), flat, begin, sizes in zip(encoded, self.flat, self.begin, self.size):
            begin.extend(flat.used + np.cumsum(size) - size)
            sizes.extend(size)
            flat.extend(ids)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Number of each of the distinct words in the store."""
        find = self.known.get
        at = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.known) + len(new) > self.limit:
            old = np.flatnonzero(at >= 0)
            kept = [self.ids(side, at[old]) for side in range(self.sides)]
            self.clear()
            self._add([words[i] for i in old], kept)
            at[old] = np.arange(len(old))
        for i in range(0, len(new), 20_000):
            part = [words[k] for k in new[i : i + 20_000]]
            at[new[i : i + 20_000]] = np.arange(len(self.known), len(self.known) + len(part))
            self._add(part, self.encode(part))
        return at

    def ids(self, side: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places one after another, and how many each has."""
        size = self.size[side].data[places]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[side].data[places] - (ends - size), size)
        return self.flat[side].data[at + np.arange(len(at))], size


def distinct(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Distinct values of a binary or text column, and the number of the value in each row."""
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary())
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1].tolist()
    data = names.buffers()[2].to_pybytes() if len(names) and names.buffers()[2] else b""
    return [data[a:b] for a, b in zip(offsets, offsets[1:])], coded.indices.to_numpy()


def bounds(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Offsets of texts among the ids, from ids per word and the first word of each text."""
    return np.concatenate([[0], np.cumsum(sizes)])[first]


#: Words of printable ASCII and Latin letters, unchanged by NFC and already in lower case, without apostrophes, and the
#: pieces that the split pattern of the vocabulary cuts them into.
_PLAIN = re.compile("[!-&(-@\\[-~\u00df-\u00f6\u00f8-\u00ff]+")
_UNITS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
#: Words encoded in one call.
_LOT = 1_000


@lru_cache(None)
def _word_store(path: str) -> WordStore:
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    units = Tokenizer(tokenizer.model)  # of units already split: white space between them, their last id marked as an end
    units.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    vocabulary_ids = tokenizer.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocabulary_ids.values()) + 1, bool)
    ends[[i for t, i in vocabulary_ids.items() if t.endswith("</w>")]] = True
    # The byte-level alphabet of the vocabulary: printable bytes stand for themselves, the n-th other byte is U+0100 + n.
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in shown) if b != 0x20}

    def joined(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray] | None:
        text = " ".join([u for w in words for u in w])
        text = text if text.isascii() else text.encode().decode("latin-1").translate(letters)
        ids = np.array(units.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(ends[ids]) + 1
        upto = np.cumsum([len(w) for w in words])
        return (ids, np.diff(last[upto - 1], prepend=0)) if len(last) == upto[-1] else None

    def each(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(words: list[bytes]):
        texts = [w.decode() for w in words]
        plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        slow = [i for i, p in enumerate(plain) if not p]
        parts, order = [], []
        for lot in _lots(words, plain):
            found = joined([_UNITS.findall(texts[i]) for i in lot])
            if found is None:
                slow += lot
            else:
                parts.append(found)
                order += lot
        ids = each([texts[i] for i in slow])
        parts.append((np.array([x for own in ids for x in own], np.uint32), np.array([len(x) for x in ids], np.int64)))
        return [in_order(parts, order + slow)]

    return WordStore(encode, 1, CACHE_WORDS)


def _lots(words: list[bytes], join: list[bool], size: int = _LOT) -> Iterator[list[int]]:
    """Numbers of the words that may be encoded together, ASCII ones apart from others."""
    for ascii_ in (True, False):
        own = [i for i, (w, j) in enumerate(zip(words, join)) if j and w.isascii() == ascii_]
        for at in range(0, len(own), size):
            yield own[at : at + size]


def in_order(parts: list[tuple[np.ndarray, np.ndarray]], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ids per word, given in parts that hold the words in another order: the n-th of them is word order[n]."""
    flat, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    begin = np.cumsum(size) - size
    back = np.argsort(np.array(order, np.int64))
    size, begin = size[back], begin[back]
    at = np.repeat(begin - (np.cumsum(size) - size), size)
    return flat[at + np.arange(len(at))], size


def word_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts one after another and the borders between texts, under a vocabulary that drops white space and
    lower-cases (`word_bpe_49k.json`). Null counts as empty.

    White space ends every piece of its split pattern, and neither NFC nor lower-casing of characters looks across
    it, so words can be encoded one by one. ASCII letters are lower-cased first, unless a text may hold the strings
    of special tokens, which are matched in their exact case.
    """
    texts = texts.cast(pa.string()).fill_null("")
    special = pc.match_substring(texts, "<|")
    lower = pc.ascii_lower(texts)
    words = pc.ascii_split_whitespace(pc.if_else(special, texts, lower) if pc.any(special).as_py() else lower)
    names, codes = distinct(words.flatten())
    store = _word_store(path)
    ids, size = store.ids(0, store.places(names)[codes])
    return ids, bounds(size, words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py())


def word_bpe(texts: list[bytes], path: str) -> list[np.ndarray]:
    """`word_ids` as one array per text."""
    ids, at = word_ids(pa.array(texts, pa.binary()).cast(pa.string()), path)
    return [ids[a:b] for a, b in zip(at, at[1:])]


#: White space outside ASCII, and control characters that the patterns of the libraries treat differently.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


@lru_cache(None)
def rank_encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(texts: pa.Array) -> np.ndarray:
    """Which texts hold white space that the libraries' patterns may treat differently."""
    maybe = pc.match_substring_regex(texts, "[\\x1c-\\x1f]|[^\\x00-\\x7f]").to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), bool)
    for i in np.flatnonzero(maybe):
        out[i] = bool(_ODD_SPACE.search(texts[i].as_py()))
    return out


def chunks(texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words with the white space before them, white space at a text's end, and the texts marked `whole`; first of each text."""
    words = cut(texts, SPACE)
    _, offsets = buffers(texts)
    mark = np.zeros(len(words.data) + 1, bool)
    mark[offsets] = True
    mark[words.end[~whole[words.doc]]] = True
    borders = np.flatnonzero(mark)
    column = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64).tobytes()), pa.py_buffer(words.data.tobytes())])
    return column, np.searchsorted(borders, offsets)


@lru_cache(None)
def _rank_store(path: str) -> WordStore:
    encode_whole = rank_encoding(path).encode_ordinary
    size = np.array([len(rank_encoding(path).decode_single_token_bytes(i)) for i in range(rank_encoding(path).n_vocab)], np.int64)

    def encode(words: list[bytes]):
        # a chunk that starts with white space and ends without joins others; odd ones and ends of texts stand alone
        join = [w[:1].isspace() and not w.isspace() and not _ODD_SPACE.search(w.decode()) for w in words]
        slow = [i for i, j in enumerate(join) if not j]
        parts, order = [], []
        for lot in _lots(words, join):
            ids = np.array(encode_whole(b"".join([words[i] for i in lot]).decode()), np.uint32)
            parts.append(split_ids(ids, size, [len(words[i]) for i in lot]))
            order += lot
        ids = [encode_whole(words[i].decode()) for i in slow]
        parts.append((np.array([x for own in ids for x in own], np.uint32), np.array([len(x) for x in ids], np.int64)))
        return [in_order(parts, order + slow)]

    return WordStore(encode, 1, CACHE_BESIDE)


def split_ids(ids: np.ndarray, size: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of strings encoded together and ids per string, from the bytes of every id and of every string."""
    upto, wanted = np.cumsum(size[ids]), np.cumsum(lengths)
    at = np.searchsorted(upto, wanted)
    if at[-1] != len(ids) - 1 or (upto[at] != wanted).any():
        raise ValueError("a token runs across the border of two chunks")
    return ids, np.diff(at + 1, prepend=0)


def byte_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts one after another and the borders between texts, under a byte-level vocabulary with ranks
    (`*.tiktoken`). Null counts as empty.

    A piece of its split pattern never runs from other characters into white space, so a text falls into chunks of
    white space and what follows it. Texts with white space outside ASCII are encoded whole.
    """
    texts = texts.cast(pa.string()).fill_null("")
    column, first = chunks(texts, odd_texts(texts))
    names, codes = distinct(column)
    store = _rank_store(path)
    ids, size = store.ids(0, store.places(names)[codes])
    return ids, bounds(size, first)


def byte_bpe(texts: list[bytes], path: str) -> list[np.ndarray]:
    """`byte_ids` as one array per text."""
    ids, at = byte_ids(pa.array(texts, pa.binary()).cast(pa.string()), path)
    return [ids[a:b] for a, b in zip(at, at[1:])]


@lru_cache(None)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(None)
def pair_store(piece_path: str, rank_path: str) -> WordStore:
    """Ids of single words under a vocabulary with byte fallback (`piece_bpe_32k.model`), and, each with a space before it,
    under a vocabulary with ranks. The empty word has none."""
    model, encode_whole = piece_model(piece_path), rank_encoding(rank_path).encode_ordinary
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    piece_size = np.array([1 if model.is_byte(i) else len(p.replace("\u2581", " ").encode()) for i, p in enumerate(pieces)], np.int64)
    rank_size = np.array([len(rank_encoding(rank_path).decode_single_token_bytes(i)) for i in range(rank_encoding(rank_path).n_vocab)], np.int64)

    def encode(words: list[bytes]):
        join = [bool(w) and not _ODD_SPACE.search(text := w.decode()) and "\u2581" not in text for w in words]
        sides, order = [[], []], []
        for lot in _lots(words, join, 100):
            joined, lengths = b" ".join([words[i] for i in lot]).decode(), [len(words[i]) + 1 for i in lot]
            sides[0].append(split_ids(np.array(model.encode(joined), np.uint32), piece_size, lengths))
            sides[1].append(split_ids(np.array(encode_whole(" " + joined), np.uint32), rank_size, lengths))
            order += lot
        rest = [i for i, j in enumerate(join) if not j]
        texts = [words[i].decode() for i in rest]
        for side, alone in zip(sides, (model.encode(texts, num_threads=1), [encode_whole(" " + t) if t else [] for t in texts])):
            side.append((np.array([x for own in alone for x in own], np.uint32), np.array([len(x) for x in alone], np.int64)))
        return [in_order(side, order + rest) for side in sides]

    return WordStore(encode, 2, CACHE_BESIDE)


def with_ends(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with `end_id` after each, little endian, and the borders between texts."""
    at = at + np.arange(len(at))
    flat = np.full(at[-1], end_id, "<u4")
    own = np.ones(len(flat), bool)
    own[at[1:] - 1] = False
    flat[own] = ids
    return flat, at


def batches(texts: list, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` bytes."""
    begin, used = 0, 0
    for i, t in enumerate(texts):
        if used and used + len(t) > limit:
            yield begin, i
            begin, used = i, 0
        used += len(t)
    if texts:
        yield begin, len(texts)


def raw(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast("binary").to_pylist()]
