"""Encoders by distinct words against whole texts, and token files with rows that have no key."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from barlake.llm import token_files, tokens
from barlake.llm.common import shared_folder

WORDS = ["the", "The", "it's", "a1b2", "x9", "...", "'", "'s", "naïve", "Straße", "ÀÉ", "日本", "ｆｕｌｌ", "é", "ﬁ", "🙂", "$$$", "#tag", "<|", "a|>", "_", "~", "\x7f", "\x00", "ª", "÷", "1.5", "[x]", "…", "ß.", "ö,"]


def texts():
    r = random.Random(3)
    spaces = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\u3000", "\u2003", "\x1c", "\xa0", "\x85"]
    out = ["", " ", "\n\n", "<|endoftext|> x <|startoftext|>", "Case <|ENDOFTEXT|> kept", None]
    for n in (1, 2, 5, 30, 400):
        for _ in range(12):
            out.append("".join(r.choice(WORDS) + r.choice(spaces[: r.choice([3, 8, 13])]) for _ in range(n)))
    return out


@pytest.mark.parametrize("limit", [900_000, 40])
def test_ids_equal_whole_texts(limit, monkeypatch):
    column = pa.array(texts())
    path = tokens.vocabulary("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    monkeypatch.setattr(tokens._word_store(path), "limit", limit)
    for _ in range(2):
        ids, at = tokens.word_ids(column, path)
        for i, text in enumerate(texts()):
            assert ids[at[i] : at[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
    path = tokens.vocabulary("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(tokens._rank_store(path), "limit", limit)
    for part in (column, column.slice(3, 40), column):
        ids, at = tokens.byte_ids(part, path)
        for i, text in enumerate(part.to_pylist()):
            assert ids[at[i] : at[i + 1]].tolist() == tokens.rank_encoding(path).encode_ordinary(text or ""), text


def test_slices_of_columns_and_no_rows():
    path = tokens.vocabulary("word_bpe_49k.json")
    column = pa.array(["one two", None, "three", ""])
    ids, at = tokens.word_ids(column.slice(1, 2), path)
    assert at.tolist() == [0, 0, len(ids)] and len(ids) == 1
    ids, at = tokens.word_ids(column.slice(0, 0), path)
    assert len(ids) == 0 and at.tolist() == [0]
    flat, borders = tokens.with_ends(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 1)
    assert flat.tolist() == [5, 6, 1, 1, 7, 1] and borders.tolist() == [0, 3, 4, 6]


def test_token_files_with_rows_without_key_and_one_hot_key(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 100)
    path, vocabulary = shared_folder(spark, "ids"), tokens.vocabulary("word_bpe_49k.json")
    rows = [(7 if i % 2 else i, f"word {i} " * (i % 9)) for i in range(200)] + [(None, f"none {i}") for i in range(40)] + [(None, None), (-5, None), (10**12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(df, path, vocabulary)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = spark.read.parquet(path)
    # the hot key and the rows without key lie in several ranges
    assert shards.where("first_key = 7 and last_key = 7").select("part").distinct().count() > 1
    assert shards.where("first_key is null").agg({"n_docs": "sum"}).first()[0] == 41
    found = token_files.digest(spark, path).collect()
    assert len(found) == len(rows)
    order = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((k for k, _ in rows if k is not None)) + [None] * 41
    assert [r["start"] for r in order] == np.cumsum([0, *[r["n_tokens"] for r in order[:-1]]]).tolist()
    ids = lambda t: (*[int(x) for x in tokens.word_bpe([(t or "").encode()], vocabulary)[0]], 1)
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in token_files.lookup(spark, path, [7, 4, -5, 10**12, 1, 99]).collect())
    assert got == sorted((k, ids(t)) for k, t in rows if k in (7, 4, -5, 10**12))
