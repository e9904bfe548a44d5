"""Mixtures fitted by expectation-maximisation, and what is read off them: information between features, a speech threshold.

The rounds run over partial aggregates: what a round needs of the rows is a handful of sums
for each component, formed before the shuffle, so no row travels and the driver sees
parameters only (their number follows the features, never the rows)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest variance of a component, as a share of the feature's own.
FLOOR = 1e-3


@dataclass(frozen=True)
class Normal2:
    """A component of a mixture in two dimensions."""

    weight: float
    mx: float
    my: float
    xx: float
    yy: float
    xy: float


def feature_pairs(df: DataFrame, n: int) -> DataFrame:
    """i < j, x, y of each pair of the n features of each row."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("features", i).alias("x"), F.get("features", j).alias("y")) for i in range(n) for j in range(i + 1, n)])
    return df.select(F.explode(each).alias("p")).select("p.*")


def moments(pairs: DataFrame, weight: Column | None = None) -> list[Column]:
    """Weighted sums that a component's parameters follow from."""
    w = F.lit(1.0) if weight is None else weight
    x, y = F.col("x"), F.col("y")
    return [F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * y * y).alias("wyy"), F.sum(w * x * y).alias("wxy")]


def component(r, total: float, floor: tuple[float, float]) -> Normal2:
    w = max(r["w"], 1e-300)
    mx, my = r["wx"] / w, r["wy"] / w
    return Normal2(r["w"] / total, mx, my, max(r["wxx"] / w - mx * mx, floor[0]), max(r["wyy"] / w - my * my, floor[1]), r["wxy"] / w - mx * my)


def start(r, k: int) -> list[Normal2]:
    """k components along the diagonal that the features' covariance points to, each as wide as all rows."""
    whole = component(r, r["w"], (0.0, 0.0))
    sx, sy = math.sqrt(whole.xx), math.copysign(math.sqrt(whole.yy), whole.xy)
    steps = [(2 * c + 1) / k - 1 for c in range(k)]
    return [Normal2(1 / k, whole.mx + s * sx, whole.my + s * sy, whole.xx, whole.yy, 0.0) for s in steps]


def density(c: Column, x: Column, y: Column) -> Column:
    """Of a component (struct of Normal2's fields) at (x, y), with its weight; features without spread have no density (null)."""
    det = c["xx"] * c["yy"] - c["xy"] * c["xy"]
    dx, dy = x - c["mx"], y - c["my"]
    q = (c["yy"] * dx * dx - 2 * c["xy"] * dx * dy + c["xx"] * dy * dy) / F.when(det > 0, det)
    return c["weight"] * F.exp(-q / 2) / (2 * math.pi * F.sqrt(F.when(det > 0, det)))


def bounded(c: Normal2) -> Normal2:
    """With a correlation that leaves the determinant positive."""
    most = 0.999 * math.sqrt(c.xx * c.yy)
    return Normal2(c.weight, c.mx, c.my, c.xx, c.yy, max(-most, min(most, c.xy)))


def pair_mixtures(df: DataFrame, n: int, k: int, rounds: int) -> tuple[dict[tuple[int, int], list[Normal2]], list[dict[tuple[int, int], float]]]:
    """A mixture of k components for each pair of the n features after some rounds, and the log likelihood of each pair before every round and after the last.

    A round is one aggregate over the rows: responsibilities are formed in the row and only their sums leave it.  Pairs with a
    feature that never varies, and tables without rows, have no mixture."""
    pairs = feature_pairs(df.where(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v))), n)
    first = {(r["i"], r["j"]): r for r in pairs.groupBy("i", "j").agg(*moments(pairs)).collect()}  # a row for each pair
    floors = {p: (FLOOR * component(r, r["w"], (0, 0)).xx, FLOOR * component(r, r["w"], (0, 0)).yy) for p, r in first.items()}
    now = {p: start(r, k) for p, r in first.items() if min(floors[p]) > 0}
    likelihoods: list[dict[tuple[int, int], float]] = []
    spark = df.sparkSession
    for r in range(rounds + 1):
        if not now:
            break
        rows = [(i, j, [(c.weight, c.mx, c.my, c.xx, c.yy, c.xy) for c in cs]) for (i, j), cs in now.items()]
        table = spark.createDataFrame(rows, "i int, j int, cs array<struct<weight:double,mx:double,my:double,xx:double,yy:double,xy:double>>")
        met = pairs.join(F.broadcast(table), ["i", "j"]).withColumn("d", F.transform("cs", lambda c: density(c, F.col("x"), F.col("y")))).drop("cs")
        met = met.withColumn("all", F.aggregate("d", F.lit(0.0), lambda a, b: a + b))
        if r == rounds:
            likelihoods.append({(x["i"], x["j"]): x["l"] for x in met.groupBy("i", "j").agg(F.sum(F.log(F.greatest("all", F.lit(1e-300)))).alias("l")).collect()})
            break
        parts = met.select("i", "j", "x", "y", "all", F.posexplode("d").alias("c", "d"))
        share = F.when(F.col("all") > 0, F.col("d") / F.col("all")).otherwise(1.0 / k)
        sums = parts.groupBy("i", "j", "c").agg(*moments(parts, share), F.sum(F.log(F.greatest("all", F.lit(1e-300)))).alias("l")).collect()  # k rows for each pair
        likelihoods.append({(x["i"], x["j"]): x["l"] for x in sums})
        now = {p: [bounded(component(x, first[p]["w"], floors[p])) for x in sorted((x for x in sums if (x["i"], x["j"]) == p), key=lambda x: x["c"])] for p in now}
    return now, likelihoods


def information(components: list[Normal2], cells: int = 60, reach: float = 4.0) -> float:
    """Bits that one feature says of the other under the mixture, by a grid of cells x cells over the components' means and `reach` deviations around."""
    axis = lambda m, v: np.linspace(min(getattr(c, m) - reach * math.sqrt(getattr(c, v)) for c in components), max(getattr(c, m) + reach * math.sqrt(getattr(c, v)) for c in components), cells)
    x, y = np.meshgrid(axis("mx", "xx"), axis("my", "yy"), indexing="ij")
    p = np.zeros_like(x)
    for c in components:
        det = c.xx * c.yy - c.xy**2
        dx, dy = x - c.mx, y - c.my
        p += c.weight * np.exp(-(c.yy * dx * dx - 2 * c.xy * dx * dy + c.xx * dy * dy) / (2 * det)) / (2 * math.pi * math.sqrt(det))
    p /= p.sum()
    apart = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    there = p > 0
    return float((p[there] * np.log2(p[there] / apart[there])).sum())


def mixture_information(df: DataFrame, n: int, k: int, rounds: int) -> DataFrame:
    """i, j, log_likelihood, bits for each pair of features."""
    found, likelihoods = pair_mixtures(df, n, k, rounds)
    rows = [(i, j, likelihoods[-1][i, j], information(cs)) for (i, j), cs in sorted(found.items())]
    return df.sparkSession.createDataFrame(rows, "i int, j int, log_likelihood double, bits double")


def rolled_up(info: DataFrame) -> DataFrame:
    """feature, n, mean, most, with: what each feature shares with the others, and with which it shares most (the first of equals)."""
    both = info.select(F.col("i").alias("feature"), F.col("j").alias("other"), "bits").union(info.select("j", "i", "bits"))
    best = F.min(F.struct((-F.col("bits")).alias("b"), "other"))["other"]
    return both.groupBy("feature").agg(F.count("*").alias("n"), F.avg("bits").alias("mean"), F.max("bits").alias("most"), best.alias("with"))


# ---------------------------------------------------------------- speech threshold

BINS, PARTS, THRESHOLD_ROUNDS = 256, 3, 100


def fitted(counts: np.ndarray, low: float, width: float, parts: int = PARTS, rounds: int = THRESHOLD_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of a mixture of normals on a line, from a histogram with its first bin at `low`."""
    x = low + width * (np.arange(len(counts)) + 0.5)
    total = counts.sum()
    edges = np.interp((np.arange(parts) + 0.5) / parts, np.cumsum(counts) / total, x)
    mean, var, weight = edges, np.full(parts, max(np.average((x - np.average(x, weights=counts)) ** 2, weights=counts), 1e-12) / parts), np.full(parts, 1 / parts)
    for _ in range(rounds):
        d = weight * np.exp(-((x[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)
        r = d / np.maximum(d.sum(1, keepdims=True), 1e-300) * counts[:, None]
        n = np.maximum(r.sum(0), 1e-12)
        mean = (r * x[:, None]).sum(0) / n
        var = np.maximum((r * (x[:, None] - mean) ** 2).sum(0) / n, (width / 2) ** 2 + 1e-12)
        weight = n / n.sum()
    return weight, mean, var


def line(weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> float:
    """The smallest level from which on the component of the largest mean is the likeliest, below its mean."""
    top = int(mean.argmax())
    x = np.linspace(mean.min(), mean[top], 4097)
    d = np.log(np.maximum(weight, 1e-300)) - (x[:, None] - mean) ** 2 / (2 * var) - np.log(var) / 2
    lost = np.flatnonzero(d.argmax(1) != top)
    return float(x[min(lost[-1] + 1, len(x) - 1)]) if len(lost) else float(x[0])


def speech_thresholds(energy: DataFrame, bins: int = BINS) -> DataFrame:
    """file, threshold (of log energy) from rows (file, energy): a three-part mixture is fitted to each file's histogram, `bins` counts however long the file.

    Energies that aren't positive have no logarithm and are left out; a file of one level has that level as its threshold."""
    rows = energy.where("energy > 0").select("file", F.log("energy").alias("e"))
    span = rows.groupBy("file").agg(F.min("e").alias("low"), F.max("e").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    # A wide aggregate a file would hold every bin in one row from the start; counted by bin first, a file's rows split among tasks.
    counted = rows.join(span, "file").withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("e") - F.col("low")) / width), F.lit(bins - 1))).otherwise(0))
    counted = counted.groupBy("file", "low", "high", "bin").agg(F.count("*").alias("n"))
    whole = counted.groupBy("file", "low", "high").agg(F.collect_list(F.struct("bin", "n")).alias("h"))  # at most `bins` entries

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            levels = []
            for low, high, h in zip(b["low"], b["high"], b["h"], strict=True):
                counts = np.zeros(bins)
                for x in h:
                    counts[x["bin"]] = x["n"]
                levels.append(line(*fitted(counts, low, (high - low) / bins)) if high > low else low)
            yield pd.DataFrame({"file": b["file"], "threshold": levels})

    return whole.mapInPandas(fit, f"file {energy.schema['file'].dataType.simpleString()}, threshold double")


def speech_frames(energy: DataFrame, bins: int = BINS) -> DataFrame:
    """energy's rows with `speech`: whether their log energy reaches their file's threshold."""
    rows = energy.join(speech_thresholds(energy, bins), "file", "left")
    return rows.withColumn("speech", F.coalesce((F.col("energy") > 0) & (F.log(F.when(F.col("energy") > 0, F.col("energy"))) >= F.col("threshold")), F.lit(False))).drop("threshold")


# ---------------------------------------------------------------- noise level


def noise_levels(bands: DataFrame, reach: int = 10, step: int = 10, bins: int = 30) -> DataFrame:
    """seg_id, band, frame_no, level: after every `step` frames the commonest level of each band over the last reach * step of them.

    bands: (seg_id, frame_no, magnitudes).  Levels are the middles of `bins` bins from 0 to the window's maximum; of equally
    common ones the lowest counts.  Windows are counted from blocks of `step` frames: a block's values go to the `reach` windows that
    hold it, are counted by bin before they travel, and no segment is ordered or held by a task."""
    values = bands.select("seg_id", F.floor(F.col("frame_no") / step).alias("block"), F.posexplode("magnitudes").alias("band", "v"))
    # A block's window ends with it; the next reach - 1 blocks' windows hold it too, if the segment gets that far.
    last = bands.groupBy("seg_id").agg(F.floor(F.max("frame_no") / step).alias("last"))
    values = values.join(last, "seg_id").withColumn("window", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + reach - 1, F.col("last"))))).drop("last")
    top = values.groupBy("seg_id", "band", "window").agg(F.max("v").alias("top"))
    place = F.when(F.col("top") > 0, F.least(F.floor(F.col("v") * bins / F.col("top")), F.lit(bins - 1))).otherwise(0)
    counted = values.join(top, ["seg_id", "band", "window"]).groupBy("seg_id", "band", "window", "top", place.alias("bin")).agg(F.count("*").alias("n"))
    best = counted.groupBy("seg_id", "band", "window", "top").agg(F.min(F.struct((-F.col("n")).alias("n"), "bin"))["bin"].alias("bin"))
    return best.select("seg_id", "band", ((F.col("window") + 1) * step - 1).alias("frame_no"), (F.col("top") * (F.col("bin") + 0.5) / bins).alias("level"))
