"""Front end: framing, spectra, filter banks, cepstra and band-pass filtering of sampled signals (numpy kernels per segment)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def framed(series: DataFrame, by: str, order: list[str], value: str, width: int, hop: int) -> DataFrame:
    """by, frame_no, samples: whole frames of `width` values every `hop`, as built-in windows."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = series.withColumn("__i", F.row_number().over(w) - 1)
    rows = rows.withColumn("samples", F.collect_list(value).over(w.rowsBetween(0, width - 1)))
    return rows.where((F.col("__i") % hop == 0) & (F.size("samples") == width)).select(by, (F.col("__i") / hop).cast("int").alias("frame_no"), "samples")


def power(x: np.ndarray, n_fft: int) -> np.ndarray:
    """Power spectra of Hamming-windowed rows."""
    return np.abs(np.fft.rfft(x * np.hamming(x.shape[1]), n_fft, axis=1)) ** 2


def mel(f: np.ndarray) -> np.ndarray:
    return 1127 * np.log1p(f / 700)


def mel_bank(n_filters: int, n_fft: int, rate: float, low: float, high: float) -> np.ndarray:
    """Triangles equally spaced in mel: (filters, bins)."""
    edges = np.linspace(mel(np.array(low)), mel(np.array(high)), n_filters + 2)
    bins = mel(np.arange(n_fft // 2 + 1) * rate / n_fft)
    up, down = (bins[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - bins[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def cepstra(x: np.ndarray, n_fft: int, rate: float, n_filters: int, n_cepstra: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Mel-frequency cepstra of rows of samples (pre-emphasis 0.97, orthonormal DCT-II of log energies)."""
    x = np.concatenate([x[:, :1], x[:, 1:] - 0.97 * x[:, :-1]], axis=1)
    e = np.log(np.maximum(power(x, n_fft) @ mel_bank(n_filters, n_fft, rate, low, high or rate / 2).T, 1e-10))
    k, n = np.arange(n_cepstra)[:, None], np.arange(n_filters)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * n_filters)) * np.where(k == 0, np.sqrt(1 / n_filters), np.sqrt(2 / n_filters))
    return e @ basis.T


def autocorrelation(x: np.ndarray, order: int) -> np.ndarray:
    """Of each row (or of one signal) at the lags 0..order."""
    return np.stack([(x[..., : x.shape[-1] - k] * x[..., k:]).sum(-1) for k in range(order + 1)], axis=-1)


def lpc_rows(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictors (1, a1, ...) and errors from rows of autocorrelations, by the Levinson recursion; where nothing is left to predict the rest is 0."""
    a, error = np.zeros(r.shape), r[:, 0].astype(float)
    a[:, 0] = 1
    for k in range(1, r.shape[1]):
        left = error > 0
        c = np.where(left, -(a[:, :k] * r[:, k:0:-1]).sum(1) / np.where(left, error, 1), 0.0)
        a[:, : k + 1] += c[:, None] * a[:, k::-1]
        error = np.where(left, error * (1 - c * c), 0.0)
    return a, error


def lpc(r: np.ndarray) -> tuple[np.ndarray, float]:
    a, error = lpc_rows(np.asarray(r, float)[None])
    return a[0], float(error[0])


def lpc_cepstra(a: np.ndarray, gain: float, n: int) -> np.ndarray:
    c = np.zeros(n)
    c[0] = np.log(max(gain, 1e-30))
    for k in range(1, n):
        c[k] = -(a[k] if k < len(a) else 0) - sum(j * c[j] * a[k - j] for j in range(max(1, k - len(a) + 1), k)) / k
    return c


def rasta(x: np.ndarray, pole: float = 0.94) -> np.ndarray:
    """Band-pass filter along time of each column: (0.2, 0.1, 0, -0.1, -0.2) / (1 - pole z^-1); the first four rows are 0."""
    out = np.zeros_like(x)
    for t in range(4, len(x)):
        out[t] = pole * out[t - 1] + 0.2 * x[t] + 0.1 * x[t - 1] - 0.1 * x[t - 3] - 0.2 * x[t - 4]
    return out


def spectra_of(samples: Column, n_fft: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(power(np.stack(x.to_numpy()), n_fft))) if len(x) else pd.Series([], dtype=object)

    return run(samples)


def cepstra_of(samples: Column, n_fft: int, rate: float, n_filters: int, n_cepstra: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(cepstra(np.stack(x.to_numpy()), n_fft, rate, n_filters, n_cepstra))) if len(x) else pd.Series([], dtype=object)

    return run(samples)


def crossings(samples: Column) -> Column:
    """Sign changes of a signal, as an expression."""
    sign = F.transform(samples, lambda x: F.when(x >= 0, 1).otherwise(-1))
    return F.aggregate(F.zip_with(F.slice(sign, 1, F.size(sign) - 1), F.slice(sign, 2, F.size(sign) - 1), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)


def bark(f: np.ndarray) -> np.ndarray:
    return 6 * np.arcsinh(f / 600)


def trapezoid_bank(n_filters: int, n_fft: int, rate: float) -> np.ndarray:
    """Critical bands equally spaced in bark: flat over one bark, falling on both sides: (filters, bins)."""
    bins = bark(np.arange(n_fft // 2 + 1) * rate / n_fft)
    step = bark(np.array(rate / 2)) / max(n_filters - 1, 1)
    off = bins[None, :] - step * np.arange(n_filters)[:, None]
    return np.where(off < -0.5, 10.0 ** (off + 0.5), np.where(off <= 0.5, 1.0, 10.0 ** (-2.5 * (off - 0.5))))


def banked(spectrum: Column, bank: np.ndarray) -> Column:
    """Band energies of a power spectrum, as expressions."""
    from framewright.functions.arrays import matrix_times

    return matrix_times(bank.tolist(), spectrum)


def spectral_shape(spectrum: Column, bands: int = 4) -> Column:
    """Struct of loudness (ln of the power), brightness (mean bin), bandwidth (deviation around it) and the shares of power in equal bands."""
    from framewright.functions.arrays import total

    power_, n = total(spectrum), F.size(spectrum)
    mean = total(F.transform(spectrum, lambda p, k: p * k)) / power_
    square = total(F.transform(spectrum, lambda p, k: p * k * k)) / power_
    part = lambda b: total(F.filter(F.transform(spectrum, lambda p, k: F.when(F.floor(k * bands / n) == b, p)), lambda p: p.isNotNull())) / power_
    fields = [F.log(F.greatest(power_, F.lit(1e-10))).alias("loudness"), mean.alias("brightness"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("bandwidth")]
    return F.when(power_ > 0, F.struct(*fields, *[part(b).alias(f"band{b}") for b in range(bands)]))


def predictors_of(samples: Column, order: int) -> Column:
    """Linear predictor (1, a1, ...) of each frame, by its autocorrelations."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = np.zeros((len(x), order + 1))
        n = x.map(len).to_numpy()
        for size in np.unique(n):
            rows = np.flatnonzero(n == size)
            out[rows] = lpc_rows(autocorrelation(np.stack(x.iloc[rows].to_numpy()).astype(float), order))[0]
        return pd.Series(list(out), dtype=object)

    return run(samples)


def rasta_of(bands: DataFrame, by: str, value: str = "bands", pole: float = 0.94) -> DataFrame:
    """The band-pass filter along each group's frames (frame_no): rows come sorted to their task and pass through with five rows of state."""
    rows = bands.repartition(by).sortWithinPartitions(by, "frame_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, past, out = None, [], None
        for batch in batches:
            made = []
            for key, x in zip(batch[by].tolist(), batch[value], strict=True):
                if key != now:
                    now, past = key, []
                past = [*past[-4:], np.asarray(x, float)]
                out = np.zeros_like(past[-1]) if len(past) < 5 else pole * out + 0.2 * past[4] + 0.1 * past[3] - 0.1 * past[1] - 0.2 * past[0]
                made.append(out)
            yield batch.assign(**{value: made})

    return rows.mapInPandas(run, rows.schema)


def mixed(a: DataFrame, b: DataFrame, gain_a: float, gain_b: float, skip: int = 0) -> DataFrame:
    """by, sample_no, value: two signals (by, sample_no, value) added with gains, the second from sample `skip` on; where one has ended the other goes on."""
    later = b.select("by", (F.col("sample_no") + skip).alias("sample_no"), F.col("value").alias("__v"))
    both = a.join(later, ["by", "sample_no"], "full")
    return both.select("by", "sample_no", (gain_a * F.coalesce("value", F.lit(0.0)) + gain_b * F.coalesce("__v", F.lit(0.0))).alias("value"))


def framed_rows(samples: DataFrame, width: int, hop: int) -> DataFrame:
    """by, frame_no, samples: whole frames of `width` values every `hop` of signals (by, sample_no, value) of any length.  A sample goes to the frames that hold it, so no signal is ordered or held by a task."""
    s = F.col("sample_no")
    frames = F.explode(F.sequence(F.greatest(F.floor((s - width) / hop) + 1, F.lit(0)), F.floor(s / hop)))
    rows = samples.select("by", "sample_no", "value", frames.alias("frame_no")).groupBy("by", "frame_no").agg(F.array_sort(F.collect_list(F.struct("sample_no", "value"))).alias("x"))
    return rows.where(F.size("x") == width).select("by", "frame_no", F.transform("x", lambda v: v["value"]).alias("samples"))


def cepstral_features(samples: DataFrame, rate: int, to: int, width: int, hop: int, n_fft: int, n_filters: int, n_cepstra: int, delta: int = 2) -> DataFrame:
    """seg_id, frame_no, features: signals (by, sample_no, value) brought to rate `to`, framed, as cepstra with their deltas and second deltas beside them."""
    from framewright.operators.sound import resampled
    from framewright.operators.windows import delta_weights, weighted

    own = resampled(samples, rate, to) if rate != to else samples
    first = framed_rows(own, width, hop).select(F.col("by").alias("seg_id"), "frame_no", cepstra_of(F.col("samples"), n_fft, float(to), n_filters, n_cepstra).alias("features"))
    weights = delta_weights(2 * delta + 1)
    once = weighted(first, weights, n_cepstra)
    twice = weighted(once, weights, n_cepstra)
    stacked = first.select("seg_id", "frame_no", F.col("features").alias("__0")).join(once.select("seg_id", "frame_no", F.col("features").alias("__1")), ["seg_id", "frame_no"])
    stacked = stacked.join(twice.select("seg_id", "frame_no", F.col("features").alias("__2")), ["seg_id", "frame_no"])
    return stacked.select("seg_id", "frame_no", F.concat("__0", "__1", "__2").alias("features"))
