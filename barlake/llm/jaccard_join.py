"""Exact Jaccard join of documents on word shingles: grouped prefix join, then components of the links.

1. **Sets and frequencies.** Every whole text becomes a set of 64-bit shingle hashes. Each task sorts the shingles of
   a chunk of documents and sends them, cut by hash range and each shingle once per chunk, to be counted; the counts
   of shingles that stand in two or more documents come back to the chunk. A shingle in one document only cannot be
   shared, so a document whose shared shingles are fewer than the threshold asks for has no partner and drops out.
2. **Classes.** Documents with equal sets are one class, represented by the smallest doc_id.
3. **Groups.** Shingles are ordered by document frequency; two sets that are similar enough share one of their first
   few (the prefix). Classes with identical prefix and size are one group, and only groups enter the index.
4. **Pairs.** Groups that share a prefix shingle are paired if sizes and remaining shingles allow the threshold. Pairs
   are expanded to members and verified on the exact intersection.

Links are wanted for components, so a pair whose members are connected already is never formed: the first rounds pair
each group with one partner (and each member with its group's first), and the last round forms and verifies all pairs
between different components. No pair is dropped for any other reason. A shingle that stands in very many documents
comes last in the order; the postings of one that is left are joined, never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.common import columns, release, stored
from barlake.llm.components import components
from barlake.llm.words import SPACE, cut, mix, run_hashes, slices, word_hashes

SHINGLE = 5
PERCENT = 80
CHUNK_BYTES = 6_000_000
#: Documents of a chunk are numbered in 16 bits, SEVERAL being none of them, and come in slices of so many at most.
CHUNK_DOCS, SLICE_DOCS = 60_000, 10_000
TOKENS_PER_TASK = 1_000_000
SEVERAL = 0xFFFF
NO_ID = -(2**63)

MESSAGE = "key long, chunk long, tokens binary, docs binary, counts binary, ids binary"
_MESSAGE = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
ROWS = "doc_id long, n long, f1 long, f2 long, tokens array<long>, prefix array<long>"
_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("tokens", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])


def needed(n):
    """Smallest overlap of a set of n with any partner: PERCENT of n, rounded up."""
    return -(-PERCENT * n // 100)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle count as one, none as empty."""
    words = cut(texts, SPACE, lower=True)
    h = word_hashes(words)
    runs, out = run_hashes(h, SHINGLE), []
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = last - first
        out.append(np.unique(runs[first : last - SHINGLE + 1]) if n >= SHINGLE else run_hashes(h[first:last], n) if n else h[:0])
    return out


def _six(tokens: np.ndarray) -> bytes:
    """48-bit tokens in six bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _tokens(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MESSAGE.types)], schema=_MESSAGE)


def _chunk_messages(chunk: int, ids: list, sets: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """One message per hash range with the chunk's distinct shingles, and one to the chunk itself with its documents."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.concatenate([*sets, np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(len(sets)), sizes)
    sums = lambda values, how: how.reduceat(np.append(values, np.uint64(0)), np.cumsum(sizes) - sizes) * (sizes > 0).astype(np.uint64)
    prints = [sums(mix(full + np.uint64(s)), how) if len(sets) else full for s, how in ((0x1357, np.add), (0x2468, np.bitwise_xor))]
    token = full >> np.uint64(16)
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(token)))
    distinct, many = token[begin], count > 1
    one = np.where(many, SEVERAL, doc[begin]).astype("<u2") if len(begin) else np.zeros(0, "<u2")
    edges = np.searchsorted(distinct, (np.arange(parts + 1, dtype=object) * (1 << 48) // parts).astype(np.uint64)) if parts > 1 else np.array([0, len(distinct)])
    out = []
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if b > a:
            out.append((p, chunk, _six(distinct[a:b]), one[a:b].tobytes(), count[a:b][many[a:b]].astype("<u4").tobytes(), None))
    inner = np.repeat(many, count)
    table = np.stack([np.array([NO_ID if i is None else i for i in ids], np.int64), sizes, *[f.view(np.int64) for f in prints]])
    out.append((-1 - chunk, chunk, _six(distinct[many]), doc[inner].astype("<u2").tobytes(), count[many].astype("<u4").tobytes(), table.tobytes()))
    return _messages(out)


def _count_part(group: pa.Table) -> pa.Table:
    """Document frequency of a hash range; each chunk hears of its shingles that stand in two or more documents."""
    if group["key"][0].as_py() < 0:
        return group
    rows = group.to_pylist()
    tokens = [_tokens(r["tokens"]) for r in rows]
    weights = []
    for r in rows:
        docs = np.frombuffer(r["docs"], "<u2")
        w = np.ones(len(docs), np.int64)
        w[docs == SEVERAL] = np.frombuffer(r["counts"], "<u4")
        weights.append(w)
    every, place = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(place, np.concatenate(weights), len(every)).astype(np.int64)[place]
    out, at = [], 0
    for r, own in zip(rows, tokens):
        df = total[at : at + len(own)]
        at += len(own)
        shared = df > 1
        if shared.any():
            docs = np.frombuffer(r["docs"], "<u2")[shared]
            out.append((r["key"], r["chunk"], _six(own[shared]), docs.tobytes(), np.minimum(df[shared], 2**32 - 1).astype("<u4").tobytes(), None))
    return pa.Table.from_batches([_messages(out)] if out else [], schema=_MESSAGE)


def _gather_chunk(group: pa.Table) -> pa.Table:
    """One row per document of a chunk; shared shingles and prefix only where enough are shared."""
    rows = group.to_pylist()
    info = next(r for r in rows if r["ids"] is not None)
    ids, n, f1, f2 = np.frombuffer(info["ids"], np.int64).reshape(4, -1)
    parts = [r for r in rows if r["ids"] is None]
    token = np.concatenate([_tokens(r["tokens"]) for r in parts]) if parts else np.zeros(0, np.uint64)
    doc = np.concatenate([np.frombuffer(r["docs"], "<u2") for r in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    df = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    single = doc != SEVERAL
    several = np.argsort(token[~single])
    many, many_df = token[~single][several], df[~single][several]
    counts = np.frombuffer(info["counts"], "<u4").astype(np.int64)
    flat = np.repeat(_tokens(info["tokens"]), counts)
    flat_df = many_df[np.searchsorted(many, flat)] if len(flat) else np.zeros(0, np.int64)
    token = np.concatenate([token[single], flat])
    df = np.concatenate([df[single], flat_df])
    doc = np.concatenate([doc[single], np.frombuffer(info["docs"], "<u2").astype(np.int64)])
    shared = np.bincount(doc, minlength=len(n))
    alive = (n > 0) & (shared >= needed(n))
    keep = alive[doc]
    token, df, doc = token[keep], df[keep], doc[keep]
    order = np.lexsort((token, df, doc))
    token, doc = token[order].astype(np.int64), doc[order]
    size = np.where(alive, shared, 0)
    inside = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
    head = n - needed(n) + 1 - (n - shared)
    first = token[inside < head[doc]]
    lists = [_masked(token, size, alive), _masked(first, np.where(alive, np.minimum(head, size), 0), alive)]
    key = pa.array(ids, pa.int64(), mask=ids == NO_ID)
    return pa.Table.from_arrays([key, pa.array(n), pa.array(f1), pa.array(f2), *lists], schema=_ROWS)


def _masked(flat: np.ndarray, sizes: np.ndarray, alive: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()), mask=pa.array(~alive))


def shared_sets(docs: DataFrame) -> DataFrame:
    """Set size and fingerprint of every row, with shared shingles and prefix of those that may have a partner."""
    rows = columns(docs, "doc_id", "text")
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(50_000, max(1, chars // 6 // TOKENS_PER_TASK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, sets, used = [], [], 0
        for batch in batches:
            for a, b in slices(batch.column(1), 2_000_000, SLICE_DOCS):
                part = batch.slice(a, b - a)
                ids += part.column(0).to_pylist()
                sets += shingle_sets(part.column(1))
                used += int(part.column(1).nbytes)
                if used >= CHUNK_BYTES or len(ids) + SLICE_DOCS > CHUNK_DOCS:
                    yield _chunk_messages(task << 24 | number, ids, sets, parts)
                    ids, sets, used, number = [], [], 0, number + 1
        if ids:
            yield _chunk_messages(task << 24 | number, ids, sets, parts)
        release()

    sent = rows.mapInArrow(chunks, MESSAGE)
    answers = sent.groupBy("key").applyInArrow(_count_part, MESSAGE)
    return stored(answers.groupBy("chunk").applyInArrow(_gather_chunk, ROWS), "shingles")


def _fits(a: str, b: str):
    """Sizes and remaining shingles of two postings allow the threshold."""
    n1, n2, r1, r2 = (F.col(c) for c in (f"{a}.n", f"{b}.n", f"{a}.rest", f"{b}.rest"))
    most = F.least(r1, r2) + 1
    return (100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)) & (100 * most >= PERCENT * (n1 + n2 - most))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sets reach the threshold; shingles that are not shared cannot be in an intersection."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u")
    common = F.size(F.array_intersect("t_u", "t_v"))
    return both.where(100 * common >= PERCENT * (F.col("n_u") + F.col("n_v") - common)).select("u", "v").distinct()


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("rep"))
    return members.join(labels, members["rep"] == labels["node"], "left").select(*members.columns, F.coalesce("component", "rep").alias("comp"))


def _links(rows: DataFrame) -> DataFrame | None:
    """Components (node, component) of the class representatives that are linked."""
    live = rows.where("tokens is not null and doc_id is not null")
    reps = rows.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    # by doc_id too, so that a class of very many copies is no hot key
    own = live.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "f1", "f2"]).select(F.col("doc_id").alias("rep"), "n", "tokens", "prefix")
    prefixes = stored(own.select("rep", "n", "prefix"), "prefixes")
    groups = prefixes.groupBy("n", "prefix").agg(F.min("rep").alias("gid"), F.count("*").alias("size"))
    # of n shared and unshared shingles the prefix holds n - needed + 1, the unshared ones first
    ahead = F.col("n") - F.ceil(PERCENT * F.col("n") / 100).cast("long") + 1 - F.size("prefix")
    posted = groups.select("gid", "n", "size", ahead.alias("ahead"), F.posexplode("prefix").alias("at", "token"))
    posted = posted.select("token", "gid", "n", (F.col("n") - F.col("ahead") - F.col("at") - 1).alias("rest"))
    met = posted.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    posted = stored(posted.join(met, "token"), "postings")
    met_groups = posted.select("gid").distinct()
    members = prefixes.join(groups, ["n", "prefix"]).select("rep", "gid", "size")
    members = members.join(met_groups.withColumn("_met", F.lit(1)), "gid", "left").where("size > 1 or _met = 1").select("rep", "gid")
    members = stored(members.distinct(), "members")
    sets = stored(own.select("rep", "n", "tokens").join(members.select("rep").distinct(), "rep", "left_semi"), "sets")

    found, tested = [], []

    def settle(pairs: DataFrame) -> DataFrame | None:
        pairs = stored(pairs, "pairs")
        tested.append(pairs)
        found.append(stored(_verified(pairs, sets), "links"))
        return components(reduce(DataFrame.unionByName, found))

    order = {1: F.col("gid"), 2: F.xxhash64("gid")}
    labels = None
    for number in (1, 2):
        open_ = stored(_open(posted, _labelled(members, labels)), "open")
        pivot = open_.groupBy("token").agg(F.min(F.struct(order[number].alias("_o"), "gid", "n", "rest", "low", "high")).alias("p")).select("token", "p.*").drop("_o")
        met = open_.alias("x").join(pivot.alias("y").hint("merge"), "token")
        met = met.where(_fits("x", "y") & F.expr("x.gid <> y.gid and not (x.low = x.high and y.low = y.high and x.low = y.low)"))
        weights = met.groupBy(F.col("x.gid").alias("v"), F.col("y.gid").alias("u")).agg(F.count("*").alias("w"))
        best = weights.groupBy("v").agg(F.max_by("u", F.struct("w", -F.col("u"))).alias("u")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        if number == 1:
            best = best.unionByName(members.where("rep <> gid").select(F.col("gid").alias("u"), F.col("rep").alias("v")))
        elif open_.isEmpty():
            break
        labels = settle(best.distinct())

    known = stored(_labelled(members, labels), "labelled")
    open_ = stored(_open(posted, known), "open")
    main = open_.where("low = high").groupBy("token", "low").agg(F.count("*").alias("w")).groupBy("token").agg(F.max_by("low", F.struct("w", "low")).alias("main"))
    open_ = open_.join(main, "token", "left").withColumn("minor", F.coalesce(~((F.col("low") == F.col("high")) & (F.col("low") == F.col("main"))), F.lit(True)))
    apart = F.expr("x.gid <> y.gid and (not y.minor or x.gid < y.gid) and not (x.low = x.high and y.low = y.high and x.low = y.low)")
    groups_met = open_.where("minor").alias("x").join(open_.alias("y"), "token").where(_fits("x", "y") & apart)
    groups_met = groups_met.select(F.least("x.gid", "y.gid").alias("a"), F.greatest("x.gid", "y.gid").alias("b")).distinct()
    split = known.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    if open_.isEmpty() and split.isEmpty():
        return labels
    groups_met = groups_met.unionByName(split.select(F.col("gid").alias("a"), F.col("gid").alias("b")))
    left, right = (known.select(F.col("gid").alias(g), F.col("rep").alias(r), F.col("comp").alias(c)) for g, r, c in (("a", "u", "cu"), ("b", "v", "cv")))
    pairs = groups_met.join(left, "a").join(right, "b").where("cu <> cv").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = pairs.join(reduce(DataFrame.unionByName, tested).distinct(), ["u", "v"], "left_anti")
    return settle(pairs)


def _open(posted: DataFrame, known: DataFrame) -> DataFrame:
    """Postings of shingles that join groups of different components, with the range of each group's components."""
    spans = known.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    rows = posted.join(spans, "gid")
    apart = rows.groupBy("token").agg(F.min("low").alias("_l"), F.max("high").alias("_h")).where("_l <> _h").select("token")
    return rows.join(apart, "token").select("token", "gid", "n", "rest", "low", "high")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (smallest doc_id with the same set) of every row.

    Null and empty texts have no shingles and are alone. Rows that share a doc_id are one document of the graph. A
    row without doc_id has its size and no component.
    """
    rows = shared_sets(docs)
    labels = _links(rows)
    sized = rows.select("doc_id", "n", "f1", "f2")
    classes = sized.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    # one row per class gets its component first, so that rows are joined once, in a join whose hot keys Spark can split
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("n", "f1", "f2", "rep", F.coalesce("component", "rep").alias("comp"))
    alike = sized.join(stored(named, "classes"), ["n", "f1", "f2"], "left")
    of = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return alike.select("doc_id", F.col("n").alias("n_shingles"), of("comp").alias("component_id"), of("rep").alias("class_id"))


def _keys(docs: DataFrame) -> DataFrame | None:
    """A key of its own (_key) for each further text of a doc_id that stands for several: doc_id, _f, _g, _key. None if there is none.

    `docs` has doc_id and the text's hashes _f and _g. The first text of an id is known by the id.
    """
    text = F.struct("_f", "_g")
    several = docs.groupBy("doc_id").agg(F.min(text).alias("_first"), F.max(text).alias("_last")).where("_first <> _last").select("doc_id", "_first")
    several = stored(several, "reused")
    if several.isEmpty():
        return None
    further = docs.join(several, "doc_id").where(text != F.col("_first")).select("doc_id", "_f", "_g").distinct()
    ids = docs.select(F.col("doc_id").alias("_key"))
    salt = 0
    while True:
        keys = stored(further.withColumn("_key", F.xxhash64("doc_id", "_f", "_g", F.lit(salt))), "keys")
        repeated = keys.groupBy("_key").count().where("count > 1")
        if repeated.isEmpty() and keys.join(ids, "_key", "left_semi").isEmpty():
            return keys
        salt += 1


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, once; rows without doc_id stay.

    A document is a doc_id and a text: different texts under one doc_id are linked only by their shingles. Of rows with
    equal doc_id and text the one with the smallest other columns stays.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.coalesce("text", F.lit(""))
    named = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64(text).alias("_f"), F.xxhash64(F.lit(1), text).alias("_g"), whole)
    keys = _keys(named.select("doc_id", "_f", "_g"))
    if keys is None:
        named = named.withColumn("_key", F.col("doc_id"))
        first = near_duplicates(named.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    else:
        named = named.join(keys, ["doc_id", "_f", "_g"], "left").withColumn("_key", F.coalesce("_key", "doc_id"))
        found = near_duplicates(named.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
        found = found.join(keys, "_key", "left").withColumn("_id", F.coalesce("doc_id", "_key"))
        best = F.min(F.struct("_id", F.col("doc_id").isNotNull().alias("_further"), "_f", "_g", "_key")).alias("_best")
        first = found.groupBy("component_id").agg(best).select("_best._key")
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    order = [F.col(f"_row.`{f.name}`") if _orderable(f.dataType) else F.to_json(F.struct(F.col(f"_row.`{f.name}`"))) for f in others]
    order = F.struct(F.col("text").isNotNull().alias("_some"), *[c.alias(f"_{k}") for k, c in enumerate(order)])
    kept = named.join(first, "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", order).alias("_row")).select("_row.*")
    return kept.unionByName(docs.where("doc_id is null"))
