"""Stateful and windowed operators on streams of (key, ts, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def online_norm(stream: DataFrame, alpha_mean: float, alpha_var: float) -> DataFrame:
    """key, ts, y: each value against its key's running mean and deviation (started at 0 and 1); the state is two numbers a key.

    Rows of one micro-batch are taken in order of ts; later batches must not bring earlier rows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, v = state.get if state.exists else (0.0, 1.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for x in rows["value"].tolist():
            m = (1 - alpha_mean) * m + alpha_mean * x
            v = (1 - alpha_var) * v + alpha_var * (x - m) ** 2
            out.append((x - m) / v**0.5)
        state.update((m, v))
        yield pd.DataFrame({"key": rows["key"], "ts": rows["ts"], "y": out})

    return stream.select("key", "ts", "value").groupBy("key").applyInPandasWithState(step, "key long, ts timestamp, y double", "m double, v double", "append", GroupStateTimeout.NoTimeout)


def segments(stream: DataFrame, active: float, gap: str, late: str) -> DataFrame:
    """Runs of values above `active` that no gap longer than `gap` interrupts: key, start, end, n.  Rows later than `late` are dropped by the watermark."""
    rows = stream.withWatermark("ts", late).where(F.col("value") > active)
    runs = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return runs.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "top")


def rates(stream: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Count and mean of values in sliding windows."""
    rows = stream.withWatermark("ts", late)
    w = rows.groupBy("key", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return w.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def ahead(stream: DataFrame, k: int) -> DataFrame:
    """key, ts, value, later: each value beside the one k rows on in its key, as soon as that has come; the state is the last k rows of a key.

    Rows of one micro-batch are taken in order of ts; the last k rows of a key wait for more."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts")
        times, values = state.get if state.exists else ([], [])
        times, values = [*times, *(t.value // 1000 for t in rows["ts"])], [*values, *rows["value"].tolist()]
        n = max(0, len(values) - k)
        state.update((times[n:], values[n:]))
        if n:
            yield pd.DataFrame({"key": key[0], "ts": pd.to_datetime(times[:n], unit="us"), "value": values[:n], "later": values[k : k + n]})

    return stream.select("key", "ts", "value").groupBy("key").applyInPandasWithState(step, "key long, ts timestamp, value double, later double", "times array<long>, values array<double>", "append", GroupStateTimeout.NoTimeout)


def counted(stream: DataFrame, width: int) -> DataFrame:
    """key, number, n, mean: tumbling windows of `width` rows of a key, each as soon as it is full; the state is a count, a window number and a sum.

    Rows of one micro-batch are taken in order of ts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for x in pd.concat(list(batches)).sort_values("ts")["value"].tolist():
            n, total = n + 1, total + x
            if n == width:
                out.append((key[0], number, n, total / n))
                number, n, total = number + 1, 0, 0.0
        state.update((number, n, total))
        if out:
            yield pd.DataFrame(out, columns=["key", "number", "n", "mean"])

    return stream.select("key", "ts", "value").groupBy("key").applyInPandasWithState(step, "key long, number long, n long, mean double", "number long, n long, total double", "append", GroupStateTimeout.NoTimeout)
