"""Importance resampling of documents towards a target distribution, with hashed word runs.

Features are all runs of 1 to `longest` consecutive words; each falls into one of `buckets`
buckets.  How much more often the target texts hold a bucket than the documents do is that
bucket's gain; a document's weight is the mean gain of its features, and adding noise that
only depends on its id (Gumbel's) makes "the highest scores" a draw without replacement
with probabilities in proportion to the exponential of the weight.

Scoring needs no rows but the documents': a higher-order function makes the array of a
document's buckets and another adds up their gains, looked up in one literal array of
`buckets` entries.  The counts need an aggregate, formed before the shuffle, of at most
`buckets` rows.  Ranks need none of a global sort: scores are integers in a range of some
75,000 values whatever the corpus (gains lie within 1000 times the logarithm of the feature
count, noise between -3,200 and 23,000), so the counts by score give every score the number
of documents above it; only drawn documents are shuffled, by their score, as three numbers.

A null text has no features (weight 0); a null id is hashed as empty and comes last among
ties.  Rows are scored one by one: repeated rows draw the same noise and tie (in any order).
Extra columns are ignored, an empty table gives an empty result, without target texts every
bucket's target count is 0.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST, SEED, SHARE, LEAST_WORDS = 10_000, 1, 2024, 10, 20


def words(text: Column) -> Column:
    """A-Z lower-cased words of a text (null: none)."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def bucket_array(text: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """The bucket of each feature, repeats included."""
    own = words(text)
    number = lambda run: F.pmod(F.crc32(run), F.lit(buckets)).cast("int")
    if longest == 1:
        return F.transform(own, number)

    def runs(w: Column, n: int) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(0))), lambda _, i: number(F.array_join(F.slice(w, i + 1, n), " ")))

    return F.get(F.transform(F.array(own), lambda w: F.flatten(F.array(*[runs(w, n) for n in range(1, longest + 1)]))), F.lit(0))


def totals(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """Features of all texts by bucket."""
    rows = texts.select(F.explode(bucket_array(F.col("text"), buckets, longest)).alias("bucket")).groupBy("bucket").count()
    out = [0] * buckets
    for r in rows.collect():  # at most a row for each bucket
        out[r["bucket"]] = r["count"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * log of the smoothed ratio) for each bucket."""
    n, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target, strict=True)]


def literal(values: list[int], kind: str) -> Column:
    """An array of known values; folded into one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * log(-log(u))) with u in (0, 1) from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document: one narrow pass, no row but the documents'."""
    rows = docs.select("doc_id", bucket_array(F.col("text"), len(gain), longest).alias("__buckets"))
    table = literal(gain, "int")
    rows = rows.select("doc_id", F.size("__buckets").cast("long").alias("n_features"), F.aggregate("__buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1)).alias("__sum"))
    # With runs of up to `longest` words, n words have longest * n - longest * (longest - 1) / 2 features; fewer words than that all n * (n + 1) / 2.
    n_words = F.col("n_features") if longest == 1 else F.when(
        F.col("n_features") >= longest * (longest + 1) // 2, (F.col("n_features") + longest * (longest - 1) // 2) / longest
    ).otherwise((F.sqrt(8 * F.col("n_features") + 1) - 1) / 2)
    whole = F.when(F.col("n_features") == 0, 0).otherwise((F.col("__sum") - F.pmod("__sum", "n_features")) / F.col("n_features"))
    rows = rows.select("doc_id", F.round(n_words).cast("long").alias("n_words"), "n_features", whole.cast("long").alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (of `scored`) with rank: 1, 2, ... for the share (in hundredths) of documents of enough words that is drawn, null for the others."""
    rows = rows.withColumn("__may", F.col("n_words") >= least_words)
    count = {r["score"]: r["count"] for r in rows.where("__may").groupBy("score").count().collect()}  # a row for each score: bounded, see above
    drawn = share * sum(count.values()) // 100
    above, seen = {}, 0
    for s in sorted(count, reverse=True):
        if seen >= drawn:
            break
        above[s] = seen
        seen += count[s]
    none = F.lit(None).cast("long").alias("rank")
    if not above:
        return rows.drop("__may").withColumn("rank", none)
    least = min(above)
    before = literal([above.get(s, 0) for s in range(least, max(above) + 1)], "bigint")
    place = F.element_at(before, (F.col("score") - least + 1).cast("int")) + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    top = rows.where(F.col("__may") & (F.col("score") >= least)).withColumn("rank", place.cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.union(rows.where(~F.col("__may") | (F.col("score") < least)).withColumn("rank", none)).drop("__may")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document; the scores are written once, ranks come from their counts."""
    gain = gains(totals(docs, buckets, longest), totals(target, buckets, longest))
    return ranked(cut(scored(docs, gain, longest, seed)), share, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs with all their columns and their rank; ids should be unique (a repeated id is drawn with all its rows)."""
    ranks = resample(docs, target, **options).where("rank IS NOT NULL").groupBy("doc_id").agg(F.min("rank").alias("rank"))
    return docs.drop("rank").join(ranks, "doc_id")


def sql(buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> str:
    """The same result in SQL for single words: features as rows, the checksum of each distinct word by table."""
    listed = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')"
    poly = 0xEDB88320  # the polynomial of this checksum, reversed
    return f"""
WITH tab AS MATERIALIZED (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, {poly}) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {listed('text')} AS w FROM documents),
f AS MATERIALIZED (SELECT k, unnest(w) AS w FROM d),
g AS MATERIALIZED (SELECT unnest({listed('text')}) AS w FROM benchmark),
u AS MATERIALIZED (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(w)), lambda i: ('0x' || hex(encode(w))[2 * i + 1:2 * i + 2])::BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % {buckets} AS b FROM (SELECT w FROM f UNION SELECT w FROM g), tab),
s AS (SELECT b, count(*) AS n FROM f JOIN u USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM g JOIN u USING (w) GROUP BY b),
gain AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + {buckets}) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM g) + {buckets}))))::BIGINT AS x
      FROM range({buckets}) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
m AS (SELECT k, floor(sum(x) / count(*))::BIGINT AS weight FROM f JOIN u USING (w) JOIN gain USING (b) GROUP BY k),
h AS (SELECT d.k, doc_id, len(w) AS n, coalesce(weight, 0) AS weight, ('0x' || sha256('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (k)),
c AS (SELECT k, doc_id, n, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS all_of FROM c WHERE n >= {least_words})
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= {share} * all_of // 100 THEN place END AS rank FROM c LEFT JOIN r USING (k)"""
