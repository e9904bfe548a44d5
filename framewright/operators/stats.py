"""Statistics and normalisation of features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(df: DataFrame) -> DataFrame:
    return df.select("seg_id", "frame_no", "label", F.posexplode("features").alias("dim", "v"))


def summary(df: DataFrame) -> DataFrame:
    """Per feature: mean, population deviation, extremes, where the extremes are (first by segment and frame)."""
    at = F.struct("seg_id", "frame_no")
    one = exploded(df).groupBy("dim").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.min(F.struct("v", at.alias("at"))).alias("a"), F.min(F.struct((-F.col("v")).alias("v"), at.alias("at"))).alias("b"),
    )
    return one.select("dim", "mean", "sd", "low", "high", F.col("a.at.seg_id").alias("low_seg"), F.col("a.at.frame_no").alias("low_frame"), F.col("b.at.seg_id").alias("high_seg"), F.col("b.at.frame_no").alias("high_frame"))


def histogram(df: DataFrame, bins: int) -> DataFrame:
    """dim, bin, n: equal bins between a feature's extremes."""
    rows = exploded(df)
    ends = rows.groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # a row for each feature
    place = F.when(F.col("hi") > F.col("lo"), F.floor(bins * 0.9999 * (F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")))).otherwise(0)
    return rows.join(F.broadcast(ends), "dim").groupBy("dim", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def normalise(df: DataFrame, by: list[Column], sample: bool = False) -> DataFrame:
    """(v - mean) / deviation within groups; a zero deviation counts as 1."""
    w = Window.partitionBy("dim", *by)
    sd = (F.stddev_samp if sample else F.stddev_pop)("v").over(w)
    return exploded(df).withColumn("z", (F.col("v") - F.avg("v").over(w)) / F.when((sd == 0) | sd.isNull() | F.isnan(sd), 1.0).otherwise(sd))


def normalise_all(df: DataFrame) -> DataFrame:
    """As normalise over the whole archive: its statistics are a row for each feature, so no window gathers everything."""
    rows = exploded(df)
    s = rows.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return rows.join(F.broadcast(s), "dim").withColumn("z", (F.col("v") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).drop("m", "sd")


def normalise_to(df: DataFrame, by: list[Column], mean: float, sd: float, least: float = 1e-8) -> DataFrame:
    """Within groups, to a mean and a deviation; a group without variance is an error."""
    w = Window.partitionBy("dim", *by)
    own = F.stddev_pop("v").over(w)
    fits = F.when(own < least, F.raise_error(F.concat(F.lit("no variance in feature "), F.col("dim").cast("string"))).cast("double")).otherwise(own)
    return exploded(df).withColumn("z", (F.col("v") - F.avg("v").over(w)) / fits * sd + mean)


def norms(df: DataFrame) -> DataFrame:
    """dim, mean, sd, high_in_sd, low_in_sd, from one pass: what a norms file holds, and how far the extremes lie out."""
    one = exploded(df).groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max("v").alias("__hi"), F.min("v").alias("__lo"))
    out = lambda x: F.when(F.col("sd") > 0, (F.col(x) - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")))
    return one.select("dim", "mean", "sd", out("__hi").alias("high_in_sd"), out("__lo").alias("low_in_sd"))


def self_entropy(df: DataFrame) -> DataFrame:
    """dim, bits: entropy of each feature as a Gaussian."""
    return exploded(df).groupBy("dim").agg(F.var_pop("v").alias("__v")).select("dim", (0.5 * F.log2(2 * math.pi * math.e * F.col("__v"))).alias("bits"))


def products(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v: the product of two matrices of cells (i, k, v) and (k, j, v)."""
    left, right = a.select("i", "k", F.col("v").alias("x")), b.select("k", "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def signal_statistics(series: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, mean, sd, rms of a signal."""
    v = F.col(value)
    return series.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.sqrt(F.avg(v * v)).alias("rms"))


def above(df: DataFrame, least: float) -> DataFrame:
    """dim, n: how many values of each feature exceed `least`."""
    return exploded(df).groupBy("dim").agg(F.count(F.when(F.col("v") > least, 1)).alias("n"))


def uniformise(df: DataFrame, bins: int) -> DataFrame:
    """Each value's place (0 to 1) in the piecewise-linear distribution of its feature."""
    rows = exploded(df)
    ends = rows.groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    h = histogram(df, bins)
    w = Window.partitionBy("dim").orderBy("bin")  # at most `bins` rows each
    steps = h.withColumn("below", F.sum("n").over(w) - F.col("n"))
    x = rows.join(F.broadcast(ends), "dim").withColumn("x", F.when(F.col("hi") > F.col("lo"), bins * 0.9999 * (F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(0.0))
    x = x.withColumn("bin", F.floor("x").cast("int"))
    return x.join(F.broadcast(steps), ["dim", "bin"]).withColumn("u", (F.col("below") + F.col("n") * (F.col("x") - F.col("bin"))) / F.col("total"))


def covariance(df: DataFrame, n: int) -> DataFrame:
    """i <= j, population covariance of features i and j, from one pass of sums."""
    f = lambda i: F.get("features", i)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    one = df.agg(*[F.covar_pop(f(i), f(j)).alias(f"c{i}_{j}") for i, j in cells])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in cells])).alias("c")).select("c.*")


def lagged_information(df: DataFrame, n: int, lag: int) -> DataFrame:
    """i, j, information of a Gaussian pair: feature i with feature j `lag` frames before; frames without one are skipped."""
    w = Window.partitionBy("seg_id").orderBy("frame_no")
    both = df.select("features", F.lag("features", lag).over(w).alias("past")).where("past IS NOT NULL")
    cells = [(i, j) for i in range(n) for j in range(n)]
    one = both.agg(*[F.corr(F.get("features", i), F.get("past", j)).alias(f"r{i}_{j}") for i, j in cells])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{i}_{j}").alias("r")) for i, j in cells])).alias("c")).select("c.*")
    return rows.withColumn("mi", -0.5 * F.log2(1 - F.col("r") * F.col("r")))


def scatter(df: DataFrame, n: int) -> DataFrame:
    """Within- and between-class scatter: within = sum of prior * class covariance * N/(N-1), between = mean over classes of prior * (m_c - m)(m_c - m)', m the plain mean of class means."""
    f = lambda i: F.get("features", i)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    per = df.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(f(i)).alias(f"m{i}") for i in range(n)], *[F.covar_pop(f(i), f(j)).alias(f"c{i}_{j}") for i, j in cells])  # a row for each class
    every = Window.partitionBy()
    per = per.withColumn("total", F.sum("n").over(every)).withColumn("classes", F.count("*").over(every)).withColumns({f"g{i}": F.avg(f"m{i}").over(every) for i in range(n)})
    prior = F.col("n") / F.col("total")
    parts = []
    for i, j in cells:
        parts += [F.sum(prior * F.col(f"c{i}_{j}") * F.col("n") / F.when(F.col("n") > 1, F.col("n") - 1)).alias(f"w{i}_{j}"), (F.sum(prior * (F.col(f"m{i}") - F.col(f"g{i}")) * (F.col(f"m{j}") - F.col(f"g{j}"))) / F.max("classes")).alias(f"b{i}_{j}")]
    one = per.agg(*parts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"w{i}_{j}").alias("within"), F.col(f"b{i}_{j}").alias("between")) for i, j in cells])).alias("c")).select("c.*")


def _matrix(rows: list, name: str, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r[name]
    return out


def applied(df: DataFrame, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """Features projected: directions' (f - mean)."""
    parts = [sum(((F.get("features", i) - float(mean[i])) * float(d[i]) for i in range(len(mean))), F.lit(0.0)) for d in directions.T]
    return df.withColumn("features", F.array(*parts))


def klt(df: DataFrame, n: int, whiten: bool = False) -> DataFrame:
    """Features on the eigenvectors of their covariance, largest first; an n x n matrix is all that reaches the driver."""
    values, vectors = np.linalg.eigh(_matrix(covariance(df, n).collect(), "cov", n))
    order = np.argsort(-values)
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])[order]
    mean = np.array(df.agg(*[F.avg(F.get("features", i)) for i in range(n)]).first())
    return applied(df, mean, vectors / np.sqrt(values[order]) if whiten else vectors)


def lda(df: DataFrame, n: int, keep: int) -> DataFrame:
    """Features on the leading eigenvectors of within^-1 between."""
    rows = scatter(df, n).collect()
    values, vectors = np.linalg.eig(np.linalg.solve(_matrix(rows, "within", n), _matrix(rows, "between", n)))
    order = np.argsort(-values.real)[:keep]
    directions = vectors.real[:, order]
    directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(keep)])
    return applied(df, np.zeros(n), directions)


def in_segments(df: DataFrame, segments: int) -> DataFrame:
    """Adds `part`: equal slices of each segment's frames; the last takes the rest, and a segment shorter than the number of slices is all in the last."""
    n = F.count("*").over(Window.partitionBy("seg_id"))
    size = F.floor(n / segments)
    return df.withColumn("part", F.when(size > 0, F.least(F.floor(F.col("frame_no") / F.when(size > 0, size)), F.lit(segments - 1))).otherwise(segments - 1).cast("int"))


def segmental_kmeans(df: DataFrame, k: int, segments: int, rounds: int) -> DataFrame:
    """label, part, cluster, n, centre: k means of the frames of each word (label) and slice, after some rounds of assigning frames to the nearest mean.

    Means begin as each cell's first k distinct frames by (seg_id, frame_no).  A mean that loses all its frames goes.  Frames
    meet only the k means of their cell."""
    from framewright.operators.graph import written

    frames = written(in_segments(df, segments).select("seg_id", "frame_no", "label", "part", "features"))
    width = frames.agg(F.max(F.size("features"))).first()[0] or 0
    first = frames.groupBy("label", "part", "features").agg(F.min(F.struct("seg_id", "frame_no")).alias("at"))
    first = first.withColumn("cluster", F.row_number().over(Window.partitionBy("label", "part").orderBy("at")) - 1).where(F.col("cluster") < k)
    means = written(first.select("label", "part", "cluster", F.col("features").alias("centre"), F.lit(0).cast("long").alias("n")))
    for _ in range(rounds):
        table = means.groupBy("label", "part").agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("means"))  # k means a row
        far = F.transform("means", lambda m: F.struct(F.aggregate(F.zip_with(m["centre"], F.col("features"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), m["cluster"].alias("cluster")))
        near = frames.join(table, ["label", "part"]).select("label", "part", F.array_min(far)["cluster"].alias("cluster"), "features")
        means = written(near.groupBy("label", "part", "cluster").agg(F.array(*[F.avg(F.get("features", i)) for i in range(width)]).alias("centre"), F.count("*").alias("n")))
    return means.select("label", "part", "cluster", "n", "centre")


def kmeans(df: DataFrame, k: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """Adds `cluster`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("__v", array_to_vector("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="cluster").fit(rows).transform(rows).drop("__v")


def gaussianise(df: DataFrame, bins: int, clip: float = 3.0) -> DataFrame:
    """uniformise, then the inverse normal distribution, clipped to +-clip deviations."""
    from statistics import NormalDist

    edge = 1 - NormalDist().cdf(abs(clip))

    @F.pandas_udf("double")
    def probit(u: pd.Series) -> pd.Series:
        return (edge + u.clip(0, 1) * (1 - 2 * edge)).map(NormalDist().inv_cdf)

    return uniformise(df, bins).withColumn("g", probit("u"))


def segment_posteriors(df: DataFrame, confidence: Column) -> DataFrame:
    """Per segment and class (seg_id, p): confidence-weighted mean and deviation of the class's probability."""
    rows = df.select("seg_id", confidence.alias("w"), F.posexplode("p").alias("cls", "v"))
    per = rows.groupBy("seg_id", "cls").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"), (F.sum(F.col("w") * F.col("v") * F.col("v")) / F.sum("w")).alias("square"))
    return per.select("seg_id", "cls", "mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"))


def segment_classes(df: DataFrame, confidence: Column) -> DataFrame:
    """seg_id, best (the class of the largest mean, the first of equals), label (the segment's commonest, the lowest of equals), right."""
    per = segment_posteriors(df, confidence)
    best = per.groupBy("seg_id").agg(F.min(F.struct((-F.col("mean")).alias("m"), "cls"))["cls"].alias("best"))
    labels = df.groupBy("seg_id", "label").agg(F.count("*").alias("n")).groupBy("seg_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
    return best.join(labels, "seg_id").withColumn("right", F.col("best") == F.col("label"))
