"""Centroid clustering by sort-means, in exact integers.

Each round orders, for every centroid, the other centroids by their distance from it.  A
vector starts at the centroid it was assigned to before and meets the others in that order;
by the triangle inequality none that is strictly further from the previous centroid than
twice the vector's own distance to it can be nearer or tie, so the scan ends there.

A round is two jobs: a narrow pass that assigns the vectors of the last round's table and
writes them with their new assignment, and an aggregate over that table with a row of exact
sums for each centroid.  Only those sums reach the driver.  The table of the round before is
removed when the next is complete, so two are on disk at most, and a lost executor costs a
reread.  A cluster may hold most of the vectors: sums are formed before the shuffle.

Kept are vectors of exactly `dims` components, all non-null, finite and of absolute value
below `LIMIT`; beyond it squared distances would leave the long type, so such vectors are
left out like those with infinities.  Equal vectors get equal clusters (ties go to the
smaller number), repeated ids are clustered row by row, a row with a null id is clustered
but begins as a centroid only where too few others are there.  Extra columns are ignored, an
empty table gives an empty result, and of fewer vectors than centroids each begins one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import cut, discard

DIMS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Components below this give integers below 2**27, and squared distances of 64 components below 2**63.
LIMIT = 131072.0
STATE = "vec_id long, v array<int>, cluster int, distance long"


def kept(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of int): floor(scale * component) of the vectors that are kept."""
    fine = lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT, F.lit(False))
    rows = vectors.where((F.size("embedding") == dims) & F.forall("embedding", fine))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def starts(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order (equal ids by their vectors, null ids last)."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return [list(r["v"]) for r in rows.orderBy(order, "v").limit(k).select("v").collect()]  # k rows


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, exact."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row of x (n, dims), scanned from the previous cluster of each."""
    between = squared(centroids[:, None], centroids[None])
    cluster, best = before.copy(), np.zeros(len(x), np.int64)
    for p in np.unique(before):
        rows = np.flatnonzero(before == p)
        own = squared(x[rows], centroids[p])
        best[rows] = own
        for c in np.argsort(between[p], kind="stable"):
            if c == p:
                continue
            # Squares: twice the distance is four times its square.  The order only goes further out, so rows that stop stay out.
            near = between[p, c] <= 4 * own
            rows, own = rows[near], own[near]
            if not len(rows):
                break
            d = squared(x[rows], centroids[c])
            better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = d[better], c
    return cluster, best


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """STATE of each row of (vec_id, v, cluster): its nearest centroid and the squared distance."""
    points = np.array(centroids, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, points.shape[1])
            cluster, distance = nearest(x, b.column("cluster").to_numpy(zero_copy_only=False), points)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster").mapInArrow(assign, STATE)


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floored means of the clusters; an empty one stays."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(len(centroids[0]))]
    out = [list(c) for c in centroids]
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return out


def sort_means(rows: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """STATE of all rows of (vec_id, v) after the rounds and one more assignment, and the final centroids."""
    state = cut(rows.select("vec_id", "v", F.lit(0).alias("cluster")))
    for r in range(rounds + 1):
        last, state = state, cut(assigned(state, centroids))
        discard(last)
        if r < rounds:
            centroids = moved(state, centroids)
    return state, centroids


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    rows = kept(vectors, dims)
    first = starts(rows, k, seed)
    names = {"cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    if not first:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *[F.lit(None).cast(t).alias(c) for c, t in names.items()])
    state, centroids = sort_means(rows, first, rounds)
    found = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return state.select(
        "vec_id", "cluster", "distance", per([found.get(c, 0) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(found.values())).cast("bigint").alias("inertia"), per(digest, "string").alias("centroid_sha256"),
    )


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> str:
    """The same result in SQL: every vector against every centroid, each round."""
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT id, any_value(v) AS v, arg_min(c, (d, c)) AS cluster, min(d) AS distance
      FROM (SELECT id, p.v, c, list_sum(list_transform(list_zip(p.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p, c{r} m) GROUP BY id)"""  # noqa: E731
    move = lambda r: f"""s{r} AS (SELECT cluster, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(w, v) AS v FROM c{r} LEFT JOIN
      (SELECT cluster, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS w FROM s{r} GROUP BY cluster) ON c = cluster)"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{move(r)}" for r in range(rounds)) + f",\n{near(rounds)}"
    return f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(x::DOUBLE) < {LIMIT})) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS c, v FROM p ORDER BY c LIMIT {k}),
{steps}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN p USING (id) JOIN c{rounds} m ON m.c = cluster"""
