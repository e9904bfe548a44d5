"""Segmental clustering by Viterbi: words cut into ordered slices whose means are learned with the cuts.

A run is a sequence of frames of one label.  Each label has `slices` means in order; a round
cuts every run into consecutive, non-empty slices so that its frames' squared distances to the means
of their slices are least (dynamic programming in the task that holds the run), then moves each
mean to the average of its frames (one aggregate).  Neither step can raise the total, so it
never rises.  Means are all that reaches the driver: slices times labels.

A run with fewer frames than slices fills the first of them.  Frames with null, non-finite or
missing features are left out before; a mean that no frame fell to stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.graph import written

CUT = "run string, label int, slice int, n long, cost double, sums array<double>, first long"


def runs(frames: DataFrame, run: list[str], order: list[str], width: int) -> DataFrame:
    """run, label, frames (in order): a row for each run, whose frames share a label."""
    fine = F.coalesce((F.size("features") == width) & F.forall("features", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)), F.lit(False))
    rows = frames.where(fine).groupBy(F.concat_ws("-", *run).alias("run"), F.col("label").cast("int").alias("label"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "features"))), lambda x: x["features"]).alias("frames"))


def cuts_of(d: np.ndarray) -> tuple[float, np.ndarray]:
    """The least cost of distances d (frames x slices) over ordered, non-empty slices, and the first frame of each slice that has any.

    Of equally good cuts the one whose last slices begin earliest."""
    n, k = d.shape[0], min(d.shape)
    sums = np.vstack((np.zeros(d.shape[1]), np.cumsum(d, axis=0)))
    best, back = sums[:, 0].copy(), np.zeros((k, n + 1), np.int64)
    for s in range(1, k):
        # best[t]: the first t frames in slices 0..s-1; slice s takes frames t..u-1.
        open_ = best - sums[:, s]
        open_[:s] = np.inf
        least = np.minimum.accumulate(open_)
        place = np.maximum.accumulate(np.where(open_ < np.concatenate(([np.inf], least[:-1])), np.arange(n + 1), 0))
        now = np.full(n + 1, np.inf)
        now[s + 1 :] = least[s:-1] + sums[s + 1 :, s]
        back[s, s + 1 :] = place[s:-1]
        best = now
    firsts, end = np.zeros(k, np.int64), n
    for s in range(k - 1, 0, -1):
        firsts[s] = end = back[s, end]
    return float(best[n]), firsts


def cut(rows: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """CUT: what each run gives to each of its slices, and the frame at which the slice begins."""
    slices = next(iter(means.values())).shape[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, label, frames in zip(b["run"], b["label"], b["frames"], strict=True):
                x = np.stack(frames).astype(np.float64)
                d = ((x[:, None] - means[label][None, : min(slices, len(x))]) ** 2).sum(2)
                cost, firsts = cuts_of(d)
                for s, (i, j) in enumerate(zip(firsts, [*firsts[1:], len(x)], strict=True)):
                    out.append((name, label, s, j - i, cost if s == 0 else 0.0, x[i:j].sum(0), i))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CUT.split(", ")])

    return rows.mapInPandas(run, CUT)


def evenly(rows: DataFrame, slices: int, width: int) -> DataFrame:
    """CUT of runs in slices of equal length (the first frame of slice s is n * s // slices): where the rounds start."""
    n = F.size("frames")
    k = F.least(n, F.lit(slices))
    each = F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda s: F.struct(s.alias("slice"), F.floor(n * s / k).cast("int").alias("first"), F.floor(n * (s + 1) / k).cast("int").alias("end"))))
    rows = rows.withColumn("c", each).withColumn("own", F.slice("frames", F.col("c.first") + 1, F.col("c.end") - F.col("c.first")))
    sums = F.array(*[total("own", i) for i in range(width)])
    return rows.select("run", "label", "c.slice", F.size("own").cast("long").alias("n"), F.lit(0.0).alias("cost"), sums.alias("sums"), F.col("c.first").cast("long").alias("first"))


def total(frames: str, i: int) -> Column:
    return F.aggregate(frames, F.lit(0.0), lambda a, x: a + F.get(x, i))


def averaged(parts: DataFrame, width: int, before: dict[int, np.ndarray], slices: int) -> tuple[dict[int, np.ndarray], dict[tuple[int, int], int], float]:
    """Means and numbers of frames of each label and slice, and the total cost of the cut."""
    rows = parts.groupBy("label", "slice").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(width)]).collect()  # a row for each mean
    means = {k: v.copy() for k, v in before.items()}
    for r in rows:
        means.setdefault(r["label"], np.zeros((slices, width)))[r["slice"]] = [r[f"s{i}"] / r["n"] for i in range(width)]
    return means, {(r["label"], r["slice"]): r["n"] for r in rows}, sum(r["cost"] for r in rows)


def viterbi_kmeans(frames: DataFrame, run: list[str], order: list[str], width: int, slices: int, rounds: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """Means (label, slice, n, centre), cuts (run, label, slice, first, n) after the rounds, and the total cost of the cut of every round."""
    rows = written(runs(frames, run, order, width))
    means, counts, _ = averaged(evenly(rows, slices, width), width, {}, slices)
    costs, last = [], evenly(rows, slices, width)
    for _ in range(rounds if means else 0):
        last = written(cut(rows, means))
        means, counts, cost = averaged(last, width, means, slices)
        costs.append(cost)
    found = [(k, s, counts[k, s], m[s].tolist()) for k, m in sorted(means.items()) for s in range(slices) if (k, s) in counts]
    return frames.sparkSession.createDataFrame(found, "label int, slice int, n long, centre array<double>"), last.select("run", "label", "slice", "first", "n"), costs
