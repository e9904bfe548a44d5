"""As-of join, and a stored index of signatures that is searched by position.

The index is a table in the order of its keys: equal numbers of rows to a part, each row with
its place in the whole order.  Small `fences`, a row for each part, say where parts begin.
A search reads no more of the index than its queries need: their keys find parts by an as-of join
with the fences, a merge inside these parts finds the place where each would stand, and
the places around it name the rows to compare.  Where the needed parts are few they prune the
files that are read; where they are many the join alone selects, with the same result.

Equal queries are searched once.  Nothing is ordered in one task: places come from counts by
range (`order.places`), and a merge works on one part with the different keys asked of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.lsh import cosine, hamming, permuted
from framewright.operators.order import places

#: Rows of an index part, and the number of needed parts up to which they are named in the scan.
PART_ROWS, NAMED = 100_000, 2_000
#: Leading bits of a key, by which keys meet fences.
LEAD = 12


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, span: int, carried: list[str]) -> DataFrame:
    """left with `carried` of the last row of right whose `by` are equal and whose `on` is at most its own (null: none).

    `on` is an integer; both sides meet in ranges of `span` values, and each range begins with the last row of
    the ranges before it, so an uneven key costs a larger range only where its values are equal."""
    value = F.struct(F.col(on).alias("on"), *carried)
    events = right.select(*by, F.floor(F.col(on) / span).alias("__range"), F.col(on).alias("__on"), F.lit(0).alias("__side"), value.alias("__value"), F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType).alias("__row"))
    asked = left.select(*by, F.floor(F.col(on) / span).alias("__range"), F.col(on).alias("__on"), F.lit(1).alias("__side"), F.lit(None).cast(events.schema["__value"].dataType).alias("__value"), F.struct("*").alias("__row"))
    every = events.unionByName(asked)
    # A row for each range that holds anything: the latest of the ranges before it.
    last = every.groupBy(*by, "__range").agg(F.max("__value").alias("__last"))
    before = last.withColumn("__before", F.max("__last").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    here = F.last("__value", ignorenulls=True).over(Window.partitionBy(*by, "__range").orderBy("__on", "__side", "__value").rowsBetween(Window.unboundedPreceding, 0))
    rows = every.withColumn("__here", here).where("__side = 1").join(before, [*by, "__range"], "left")
    got = F.coalesce("__here", "__before")
    return rows.select("__row.*", *[got[c].alias(c) for c in carried])


def rotations(df: DataFrame, bits: int, permutations: int) -> DataFrame:
    """df's rows for each permutation: perm and key, the signature with other bits in the lead."""
    step = max(1, bits // permutations)
    each = F.array(*[F.struct(F.lit(p).alias("perm"), permuted(F.col("sig"), p * step % bits, bits).alias("key")) for p in range(permutations)])
    return df.where("sig IS NOT NULL").withColumn("__p", F.explode(each)).select("*", "__p.perm", "__p.key").drop("__p")


def build(df: DataFrame, key: str, bits: int, permutations: int, path: str, part_rows: int = PART_ROWS) -> None:
    """Stores the index of df's signatures under path: `rows` (perm, part; place, key, id, sig) and `fences` (perm, part, first key)."""
    rows = places(rotations(df.select(F.col(key).alias("id"), "sig"), bits, permutations), ["perm"], ["key", "id"])
    rows = rows.withColumn("part", F.floor(F.col("place") / part_rows)).select("place", "key", "id", "sig", "perm", "part")
    rows.repartition("perm", "part").sortWithinPartitions("perm", "part", "place").write.partitionBy("perm", "part").mode("overwrite").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    stored.groupBy("perm", "part").agg(F.min("key").alias("key"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/fences")


def search(spark: SparkSession, path: str, queries: DataFrame, key: str, bits: int, threshold: float, permutations: int, beam: int = 100, part_rows: int = PART_ROWS, named: int = NAMED) -> DataFrame:
    """query, id, h, cos: for each query the index rows of the beam/2 places before and after the place where it would stand, over the threshold of approximate cosine."""
    half = beam // 2
    index, fences = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/fences")
    own = queries.where("sig IS NOT NULL").select(F.col(key).alias("query"), "sig")
    asked = rotations(own.select("sig").distinct(), bits, permutations)
    # A query stands before all rows of its key: it belongs to the last part that begins with a smaller key, or to the first.
    found = asof(asked.withColumn("__below", F.col("key") - 1), fences.select("perm", F.col("key").alias("__below"), "part"), ["perm"], "__below", 1 << max(0, bits - LEAD), ["part"])
    found = found.select("perm", "key", "sig", F.coalesce("part", F.lit(0)).cast("long").alias("part"))
    reach = -(-half // part_rows)
    near = found.select("perm", F.explode(F.sequence(F.col("part") - reach, F.col("part") + reach)).alias("part")).distinct()
    few = near.limit(named + 1).collect()  # at most `named` + 1 rows
    if len(few) <= named:
        wanted: dict[int, list[int]] = {}
        for r in few:
            wanted.setdefault(r["perm"], []).append(r["part"])
        test = F.lit(False)
        for perm, parts in sorted(wanted.items()):
            test |= (F.col("perm") == perm) & F.col("part").isin(sorted(parts))
        index = index.where(test)
    # Places: the different keys of a part and the queries that fell into it, merged.
    inside = index.join(found.select("perm", "part").distinct(), ["perm", "part"], "left_semi").groupBy("perm", "part", "key").agg(F.min("place").alias("place"), F.max("place").alias("last"))
    both = inside.select("perm", "part", "key", F.lit(1).alias("side"), (F.col("last") + 1).alias("next"), F.lit(None).cast("long").alias("sig")).union(found.select("perm", "part", "key", F.lit(0), F.lit(None).cast("long"), "sig"))
    order = Window.partitionBy("perm", "part").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, 0)
    stand = both.withColumn("at", F.coalesce(F.max("next").over(order), F.col("part") * part_rows)).where("side = 0").select("perm", "sig", "at")
    bins = stand.withColumn("bin", F.explode(F.sequence(F.floor((F.col("at") - half) / half), F.floor((F.col("at") + half - 1) / half))))
    rows = index.select("perm", "place", "id", F.col("sig").alias("other"), F.floor(F.col("place") / half).alias("bin"))
    met = bins.join(rows, ["perm", "bin"]).where(f"place >= at - {half} AND place < at + {half}")
    h = hamming(F.col("sig"), F.col("other"))
    close = met.select("sig", "id", h.alias("h")).where(cosine(F.col("h"), bits) > threshold).distinct()
    return own.join(close, "sig").select("query", "id", "h", cosine(F.col("h"), bits).alias("cos"))
