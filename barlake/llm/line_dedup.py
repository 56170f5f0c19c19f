"""Line dedup by overlapping three-line windows, with DataFrame functions only.

A window is three consecutive lines with at least one word among them. Its key is a pair of 64-bit hashes. The first
occurrence of a window is the one with the smallest (doc_id, text hash, line number); every later one covers its
three lines. Covered lines are removed: windows overlap, so the covered lines of a longer repeated passage merge.

Shuffles: the windows twice (count and first occurrence; join with the repeated ones, where a frequent window is
split by adaptive skew handling), the covered line numbers, and the texts once.

Texts of fewer than three lines have no window and stay. Null text stays null. Rows with equal doc_id and text are
one document: they are cleaned alike and do not repeat each other. Other columns are passed on; columns named
n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]"


def _windows(docs: DataFrame) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when(x.rlike(WORD), F.xxhash64(x)).otherwise(F.lit(0)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_key"), lines.alias("_l")).where(F.size("_l") >= 3)
    n = F.size("_l") - 2
    triples = F.arrays_zip(F.slice("_l", 1, n).alias("a"), F.slice("_l", 2, n).alias("b"), F.slice("_l", 3, n).alias("c"))
    rows = rows.select("doc_id", "_key", F.posexplode(triples).alias("_at", "_w")).where("_w.a <> 0 or _w.b <> 0 or _w.c <> 0")
    return rows.select(
        F.xxhash64("_w.a", "_w.b", "_w.c").alias("_h"), F.xxhash64("_w.c", "_w.b", "_w.a", F.lit(1)).alias("_g"), "doc_id", "_key", "_at"
    )


def covered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _key and the starts of all later occurrences in each document that has any, each start once however many copies."""
    windows = _windows(docs)
    place = F.struct("doc_id", "_key", "_at")
    repeated = windows.groupBy("_h", "_g").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n")
    later = windows.join(repeated, ["_h", "_g"]).where(place > F.col("_first"))
    return later.groupBy("doc_id", "_key").agg(F.collect_set("_at").alias("_starts"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with later copies of repeated windows cut from `text`, and n_lines (before) and n_removed."""
    found = covered_lines(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": "_doc"})
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_own"))
    rows = rows.join(found, rows["_id"].eqNullSafe(found["_doc"]) & (rows["_own"] == found["_key"]), "left")
    before = F.col("_row.text")
    lines = F.split(before, "\n", -1)
    covered = F.flatten(F.transform("_starts", lambda s: F.array(s, s + 1, s + 2)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    hit = F.col("_starts").isNotNull()
    new = {
        "text": F.when(hit, text).otherwise(before),
        "n_lines": F.when(before.isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(hit, F.size(F.array_distinct(covered))).otherwise(0).cast("long"),
    }
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])


SQL = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT DISTINCT doc_id, text, l FROM lines
), windows AS (
  SELECT doc_id, text, i - 1 AS pos, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c
  FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM keyed WHERE len(l) >= 3)
  WHERE regexp_matches(l[i] || l[i + 1] || l[i + 2], '[^\\x20\\x09-\\x0D]')
), ranked AS (
  SELECT doc_id, text, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM windows
), covered AS (
  SELECT DISTINCT doc_id, text, pos + unnest([0, 1, 2]) AS pos FROM ranked WHERE n > 1
), removed AS (
  SELECT doc_id, text, count(*) AS n FROM covered GROUP BY doc_id, text
), kept AS (
  SELECT k.doc_id, k.text, string_agg(k.line, chr(10) ORDER BY k.pos) AS rest
  FROM (SELECT doc_id, text, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM keyed) k
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = k.doc_id AND c.text = k.text AND c.pos = k.pos)
  GROUP BY k.doc_id, k.text
)
SELECT d.doc_id, CASE WHEN r.n IS NULL THEN d.text ELSE coalesce(k.rest, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN removed r ON d.doc_id = r.doc_id AND d.text = r.text LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""
