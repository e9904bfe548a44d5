"""Long signals as rows: resampling over chunks with carried overlap, and pitch."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the filter on each side, and output samples of a chunk.
CROSSINGS, CHUNK = 8, 65_536


def polyphase(up: int, down: int, crossings: int = CROSSINGS) -> tuple[np.ndarray, int]:
    """Filter taps (phase, tap) of a windowed sinc that cuts at the lower of both rates, and its reach in input samples.

    Output m lies at input time m * down / up; with phase m * down mod up and k0 = m * down // up, tap j weighs input k0 - reach + 1 + j."""
    cut = min(1.0, up / down)
    reach = int(np.ceil(crossings / cut))
    t = np.arange(up)[:, None] / up - (np.arange(2 * reach) - reach + 1)[None, :]
    window = np.where(np.abs(t) < reach, 0.5 + 0.5 * np.cos(np.pi * t / reach), 0.0)
    return cut * np.sinc(cut * t) * window, reach


def filtered(x: np.ndarray, first: int, start: int, stop: int, up: int, down: int, taps: np.ndarray, reach: int) -> np.ndarray:
    """Outputs start..stop-1 from input samples x that begin at number `first`; what lies outside of x is silence."""
    m = np.arange(start, stop, dtype=np.int64) * down
    at = (m // up - reach + 1 - first)[:, None] + np.arange(2 * reach)
    there = (at >= 0) & (at < len(x))
    return (np.where(there, x[np.clip(at, 0, max(len(x) - 1, 0))], 0.0) * taps[m % up]).sum(1) if len(x) else np.zeros(stop - start)


def resampled(samples: DataFrame, rate: int, to: int, chunk: int = CHUNK, crossings: int = CROSSINGS) -> DataFrame:
    """by, sample_no, value at rate `to` of the signals (by, sample_no, value) at `rate`, n * to / rate samples (rounded up) for n.

    A recording is many chunks of `chunk` outputs; an input sample goes to the chunk of its time and, within the filter's reach of
    an edge, to the neighbour too, so every output is computed as from the whole signal and no task holds more than its chunks.
    Missing samples and nulls are silence; a sample given twice counts once (its largest value)."""
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    taps, reach = polyphase(up, down, crossings)
    whole = samples.where("value IS NOT NULL").groupBy("by", "sample_no").agg(F.max("value").alias("value"))
    ends = samples.groupBy("by").agg(F.ceil((F.max("sample_no") + 1) * up / down).alias("outputs"))
    chunk_at = lambda k: F.floor(k * up / down / chunk)  # the chunk of the output at input time k
    chunks = F.explode(F.sequence(F.greatest(chunk_at(F.col("sample_no") - reach), F.lit(0)), chunk_at(F.col("sample_no") + reach))).alias("chunk")
    parts = whole.select("by", "sample_no", "value", chunks).groupBy("by", "chunk").agg(F.array_sort(F.collect_list(F.struct("sample_no", "value"))).alias("x"))
    every = ends.select("by", "outputs", F.explode(F.sequence(F.lit(0), F.ceil(F.col("outputs") / chunk) - 1)).alias("chunk"))
    rows = every.join(parts, ["by", "chunk"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for by, n, k, x in zip(b["by"], b["outputs"], b["chunk"], b["x"], strict=True):
                start, stop = k * chunk, min((k + 1) * chunk, n)
                at = np.array([r["sample_no"] for r in x], np.int64) if x is not None else np.empty(0, np.int64)
                first = int(at[0]) if len(at) else 0
                dense = np.zeros(int(at[-1]) - first + 1 if len(at) else 0)
                dense[at - first] = [r["value"] for r in x] if len(at) else []
                yield pd.DataFrame({"by": by, "sample_no": np.arange(start, stop), "value": filtered(dense, first, start, stop, up, down, taps, reach)})

    return rows.mapInPandas(run, f"by {samples.schema['by'].dataType.simpleString()}, sample_no long, value double")


def pitched(frames: DataFrame, rate: float, least: float, most: float, strength: float = 0.3, share: float = 0.97) -> DataFrame:
    """frames with `pitch` and `periodicity`: of the peaks of each frame's autocorrelation among the lags of `least` to `most` cycles a
    second, the highest one's height, and the shortest lag whose peak has at least `share` of it (multiples of a period are as high).

    The correlation at a lag is divided by the energies of the two stretches it compares, so a lag isn't worse for being long.  A
    peak is no lower than its neighbours.  Frames without a peak of `strength` have pitch 0; null, empty and
    silent frames have periodicity 0 too.  features: the samples of a frame."""
    low, high = max(1, int(np.ceil(rate / most))), int(rate // least)

    @F.pandas_udf("pitch double, periodicity double")
    def run(features: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(features), 2))
        n = features.map(lambda v: 0 if v is None else len(v)).to_numpy()
        for size in np.unique(n[n > low + 1]):
            rows = np.flatnonzero(n == size)
            x = np.stack(features.iloc[rows].to_numpy()).astype(np.float64)
            lags = np.arange(low - 1, min(high + 1, size - 2) + 1)
            r = np.zeros((len(rows), len(lags)))
            for k, lag in enumerate(lags):
                a, b = x[:, : size - lag], x[:, lag:]
                energy = np.sqrt((a * a).sum(1) * (b * b).sum(1))
                r[:, k] = np.divide((a * b).sum(1), energy, out=np.zeros(len(rows)), where=energy > 0)
            if len(lags) < 3:
                continue
            peak = (r[:, 1:-1] >= r[:, :-2]) & (r[:, 1:-1] >= r[:, 2:])
            best = np.where(peak, r[:, 1:-1], -np.inf)
            value = best.max(1)
            at = (best >= np.where(value > 0, share * value, value)[:, None]).argmax(1)
            found = np.isfinite(value) & (value >= strength)
            out[rows, 1] = np.where(np.isfinite(value), np.maximum(value, 0), 0)
            out[rows, 0] = np.where(found, rate / lags[1:-1][at], 0)
        return pd.DataFrame(out, columns=["pitch", "periodicity"])

    return frames.withColumn("__p", run("features")).select(*frames.columns, "__p.pitch", "__p.periodicity")
