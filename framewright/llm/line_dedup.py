"""Line dedup by a deletion-neighbourhood join.

A line (trimmed of spaces) of at least `min_chars` characters goes if an earlier
line, by (doc_id, text hash, line number), lies within one edit (a character
inserted, deleted or substituted).  Shorter lines always stay: `min_chars` (20 by
default, 1 for all lines) says what a line worth comparing is.

1. Equal lines become one row with their first occurrence (map-side combined, so
   a line that a third of all documents share costs a row for each task).
2. One edit leaves the first or the second half of a line alone: only lines that
   share such a half, at a length within one, go on.  This filter is exact.  Halves
   are counted with partial sums and joined back, so one that a third of all lines
   share is split over tasks.
3. These emit their deletion neighbourhood: the line itself and every variant with
   one character less (in the half that may differ), as hashed keys.  Lines that differ by a substitution share
   a variant with the same deleted place; by an insertion, one line is a variant of
   the other.  A variant and a place fix a line up to one character, so the groups
   are bounded by the alphabet, however many lines are alike.
4. The earliest neighbour of each line is verified by edit distance.
5. The kept line numbers go back to their documents.

Null texts stay null; texts without lines to drop stay as they are.  A document
stored twice (same id and text) counts once, and both copies keep the same lines.
Other columns pass through unchanged, but for n_lines and n_removed, which are the
result's.  Working columns begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import cut

MIN_CHARS = 20
ORDER = ("__d", "__h", "__p")  # document, text hash, line number


def key_columns(docs: DataFrame) -> DataFrame:
    lowest = F.lit(-(2**63)).cast("long")
    return docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), lowest), "__h": F.xxhash64("text")})


def earlier(a: str, b: str) -> Column:
    """Whether occurrence struct a comes before b."""
    return F.col(a) < F.col(b)


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """__d, __h, __p (first occurrence), n (length) and half keys of every distinct line of at least min_chars; no text is shuffled.

    Lines within one edit share a first or second half: floor(s / 2) characters, s the shorter one's length.  A line of n
    characters may be the shorter or the longer one, so it has keys for n and n - 1, which coincide for odd n."""
    lines = key_columns(docs).select("__d", "__h", F.posexplode(F.split("text", "\n")).alias("__p", "line"))
    lines = lines.select(*ORDER, F.trim("line").alias("line")).withColumn("n", F.length("line")).where(F.col("n") >= min_chars)
    n = F.col("n")
    first = lambda half: F.xxhash64(F.lit(0), half, F.substring("line", F.lit(1), half))
    second = lambda half: F.xxhash64(F.lit(1), half, F.substring("line", n - half + 1, half))
    own, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    row = F.struct(*ORDER, "n", first(own).alias("a"), second(own).alias("b"), F.when(own != less, first(less)).alias("c"), F.when(own != less, second(less)).alias("e"))
    rows = lines.select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), row.alias("x"))
    return rows.groupBy("k1", "k2").agg(F.min("x").alias("x")).select("x.*")


def hopeful(lines: DataFrame) -> DataFrame:
    """__d, __h, __p, first, second: the distinct lines whose first or second half another one shares."""
    each = lines.select(*ORDER, F.posexplode(F.array("a", "b", "c", "e")).alias("side", "half")).where("half IS NOT NULL")
    # The halves are written first: then both sides of the join come straight from a shuffle, and Spark splits a hot half.
    shared = cut(each.groupBy("half").agg(F.count("*").alias("m")).where("m > 1").select("half"))
    return each.join(shared, "half").groupBy(*ORDER).agg(F.max(F.col("side") % 2 == 0).alias("first"), F.max(F.col("side") % 2 == 1).alias("second"))


#: Two odd bases of polynomial hashes modulo 2^64, and the multiplier that spreads code points.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPREAD = 0xD6E8FEB86659FD93


def neighbourhood(line: str) -> tuple[np.ndarray, np.ndarray]:
    """(n+1, 2) signed 64-bit keys of the line and its n single deletions, and the deleted places (-1: none); linear in n."""
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    points = points * np.uint64(SPREAD)
    points ^= points >> np.uint64(29)
    n, out = len(points), np.empty((len(points) + 1, 2), np.uint64)
    for k, base in enumerate(BASES):
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * powers[:n], dtype=np.uint64)))
        inverse = np.uint64(pow(base, -1, 2**64))
        out[0, k] = sums[n]
        out[1:, k] = sums[:n] + (sums[n] - sums[1:]) * inverse
    return out.view(np.int64), np.arange(-1, n)


def neighbourhoods(base: DataFrame, lines: DataFrame) -> DataFrame:
    """__d, __h, __p with a row (v, place) for each hopeful line and its deletions; the line itself (place -1) carries its text.

    A shared first half puts the edit behind it, a shared second half before it: only those places are deleted."""
    schema = "__d long, __h long, __p int, v long, place int, line string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for d, h, text, wanted in zip(batch["__d"].tolist(), batch["__h"].tolist(), batch["text"].tolist(), batch["__wanted"], strict=True):
                parts = text.split("\n")
                for w in wanted:
                    line = parts[w["__p"]].strip(" ")
                    keys, place = neighbourhood(line)
                    half = (len(line) - 1) // 2
                    take = (place < 0) | (w["first"] & (place >= half)) | (w["second"] & (place < len(line) - half))
                    n = int(take.sum())
                    out.append((np.full(n, d), np.full(n, h), np.full(n, w["__p"], np.int32), keys[take, 0] ^ (keys[take, 1] >> 7), place[take].astype(np.int32), [line] + [None] * (n - 1)))
                    size += n
                    if size > 500_000:
                        yield frame(out)
                        out, size = [], 0
            if out:
                yield frame(out)

    def frame(parts: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*parts, strict=True))
        data = {k: np.concatenate(c) for k, c in zip((*ORDER, "v", "place"), columns, strict=False)}
        return pd.DataFrame(data | {"line": [x for c in columns[5] for x in c]})

    wanted = hopeful(lines).groupBy("__d", "__h").agg(F.collect_list(F.struct("__p", "first", "second")).alias("__wanted"))
    # All of the documents' columns stay, so that this join and the last one share a single shuffle of the texts.
    return base.join(wanted, ["__d", "__h"]).mapInPandas(run, schema)


def near_duplicates(base: DataFrame, lines: DataFrame) -> DataFrame:
    """__d, __h, __p of the distinct lines that have an earlier line within one edit."""
    variants = neighbourhoods(base, lines)
    slim = variants.select("v", "place", F.struct(*ORDER).alias("at"))
    key = Window.partitionBy("v")
    whole, less = F.min(F.when(F.col("place") < 0, F.col("at"))).over(key), F.min(F.when(F.col("place") >= 0, F.col("at"))).over(key)
    same = F.min("at").over(Window.partitionBy("v", "place"))
    found = slim.select("at", F.when(F.col("place") < 0, less).otherwise(F.least(whole, same)).alias("other"))
    earliest = found.where(earlier("other", "at")).groupBy("at").agg(F.min("other").alias("other"))
    texts = variants.where("place < 0").select(F.struct(*ORDER).alias("at"), "line")
    others = texts.select(F.col("at").alias("other"), F.col("line").alias("other_line"))
    both = earliest.join(texts, "at").join(others, "other")
    return both.where(F.levenshtein("line", "other_line") <= 1).select("at.*")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with repeated lines removed from `text`, and n_lines, n_removed (both null for a null text)."""
    lines = cut(distinct_lines(docs, min_chars))
    base = key_columns(docs.drop("n_lines", "n_removed"))
    kept = lines.select(*ORDER).join(near_duplicates(base, lines), list(ORDER), "left_anti")
    kept = kept.groupBy("__d", "__h").agg(F.collect_list("__p").alias("__kept"))
    rows = base.join(kept, ["__d", "__h"], "left")
    parts = F.split("text", "\n")
    stays = lambda x, i: (F.length(F.trim(x)) < min_chars) | F.coalesce(F.array_contains("__kept", i), F.lit(False))
    rows = rows.withColumn("__lines", F.filter(parts, stays))
    return rows.select(
        *[F.array_join("__lines", "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.size(parts).cast("long").alias("n_lines"), (F.size(parts) - F.size("__lines")).cast("long").alias("n_removed"),
    )


def sql() -> str:
    """The same in SQL, each distinct line against every other of like length."""
    return f"""
WITH l AS (SELECT doc_id, pos, line, trim(line) AS t, length(trim(line)) AS n
           FROM (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
f AS (SELECT t, n, doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k FROM l WHERE n >= {MIN_CHARS}) WHERE k = 1),
g AS (SELECT DISTINCT a.t FROM f a JOIN f b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos))
      AND (left(a.t, CAST(floor(least(a.n, b.n) / 2) AS BIGINT)) = left(b.t, CAST(floor(least(a.n, b.n) / 2) AS BIGINT))
           OR right(a.t, CAST(floor(least(a.n, b.n) / 2) AS BIGINT)) = right(b.t, CAST(floor(least(a.n, b.n) / 2) AS BIGINT)))
      WHERE levenshtein(a.t, b.t) <= 1),
k AS (SELECT doc_id, pos FROM f WHERE t NOT IN (SELECT t FROM g)),
r AS (SELECT l.*, n < {MIN_CHARS} OR k.pos IS NOT NULL AS keep FROM l LEFT JOIN k ON k.doc_id = l.doc_id AND k.pos = l.pos)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '') END AS text,
       count(line) AS n_lines, count(line) FILTER (WHERE NOT keep) AS n_removed
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, d.text"""
