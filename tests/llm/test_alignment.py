"""Alignment of two tokenisations against a plain loop over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barlake.llm import alignment
from barlake.llm.tokens import vocabulary

DOCS = "doc_id long, text string, piece string, pair string, docs int"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_bytes():
    a, b = Tokenizer.from_file(vocabulary(A)), sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    a.encode_special_tokens = True
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    back, n = {chr(c): c for c in shown}, 0
    for c in range(256):
        if c not in shown:
            back[chr(256 + n)] = c
            n += 1
    side_a = lambda i: bytes(back[c] for c in a.id_to_token(i))

    def side_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return (lambda t: a.encode(t, add_special_tokens=False).ids), side_a, b.encode, side_b


def brute(rows):
    encode_a, bytes_a, encode_b, bytes_b = token_bytes()
    aligned = []
    for doc_id, text, *_ in rows:
        ids_a, ids_b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        whole = b" " + text.encode() if text else b""
        if b"".join(map(bytes_a, ids_a)) != whole or b"".join(map(bytes_b, ids_b)) != whole:
            ids_a, ids_b = [], []
        ends = []
        for ids, size in ((ids_a, bytes_a), (ids_b, bytes_b)):
            total, own = 0, {}
            for k, i in enumerate(ids):
                total += len(size(i))
                own[total] = k
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in common:
            x, y = ends[0][e] + 1, ends[1][e] + 1
            groups.append((ids_a[i:x], ids_b[j:y]))
            i, j = x, y
        aligned.append((doc_id, ids_a, ids_b, groups, [(ids_a[ends[0][e]], ids_b[ends[1][e]]) for e in common]))
    count = Counter(link for row in aligned for link in row[4])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, ids_a, ids_b, groups, links in aligned:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if ids_a else ""
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(7)
    words = ["the", "tokens", "of", "straße", "naïve", "\t", "  ", "\n", "x9z", "§", "日本語", "emoji 🙂", "don't", "<|endoftext|>", "</s>", "supercalifragilistic", "a1b2", "..."]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [None, "", " ", "\n", "▁", "a▁b", "plain words here", " two  spaces   three ", "tail \n\n ", "\x00\x01\x1c\x85", "cr\r\nlf\r\r x", "\xa0nbsp x", "é ﬁ Ａ"]
    texts += [prose(20) for _ in range(30)] + [prose(6000), "z" * 3000, " " * 700, prose(40) + "▁", "plain words here"]
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[14], (None, "no id at all", None, None, None), (None, None, None, None, None)]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("work", [alignment.WORK, 5000, 37])
def test_alignment_equals_a_loop_over_whole_texts(spark, work):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert got(alignment.align(df, vocabulary(A), vocabulary(B), work)) == brute(rows)


def test_empty_and_null_tables(spark):
    path = vocabulary(A), vocabulary(B)
    assert alignment.align(spark.createDataFrame([], DOCS), *path).collect() == []
    none = spark.createDataFrame([(1, None), (None, None), (2, "")], "doc_id long, text string")
    assert got(alignment.align(none, *path)) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, None, 2)], key=repr)


def test_merge_path_cuts_equal_work():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 400, r.integers(0, 120))) for _ in range(2))
        if len(a) + len(b):
            top = max(a.max(initial=0), b.max(initial=0)) + 1
            a, b = np.append(a, top), np.append(b, top)
        for work in (1, 7, 64):
            borders = alignment.cuts(a, b, work)
            assert borders[0] == (0, 0) and borders[-1] == (len(a), len(b))
            links = []
            for (i, j), (x, y) in zip(borders, borders[1:]):
                assert x >= i and y >= j and x - i + y - j <= work + 1
                la, lb = alignment.common_ends(a[i:x], b[j:y])
                links += a[i:x][la].tolist()
            assert links == sorted(set(a) & set(b))
