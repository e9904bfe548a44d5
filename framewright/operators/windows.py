"""Windowed operators on frames and time series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_order() -> WindowSpec:
    """A segment's frames up to the current one."""
    return Window.partitionBy("seg_id").orderBy("frame_no")


def context(df: DataFrame, width: int) -> DataFrame:
    """Features of `width` frames from each frame on; frames without that many are dropped."""
    w = in_order().rowsBetween(0, width - 1)
    rows = df.withColumn("__all", F.collect_list("features").over(w)).where(F.size("__all") == width)
    return rows.withColumn("features", F.flatten("__all")).drop("__all")


def clamped(df: DataFrame, reach: int) -> DataFrame:
    """Adds `near`: the feature arrays at -reach .. +reach, edge frames repeated."""
    first, last = F.first("features").over(in_order()), F.last("features").over(in_order().rowsBetween(0, Window.unboundedFollowing))
    parts = [F.coalesce(F.lag("features", -k).over(in_order()), last if k > 0 else first) for k in range(-reach, reach + 1)]
    return df.withColumn("near", F.array(*parts))


def weighted(df: DataFrame, weights: list[float], n: int) -> DataFrame:
    """A finite filter along each segment: features become the sum of weights[k] * frame t + k."""
    reach = len(weights) // 2
    value = lambda d: sum((F.lit(float(w)) * F.get(F.get("near", k), d) for k, w in enumerate(weights) if w), F.lit(0.0))
    return clamped(df, reach).withColumn("features", F.array(*[value(d) for d in range(n)])).drop("near")


def delta_weights(width: int) -> list[float]:
    m = (width - 1) // 2
    return [float(k) for k in range(-m, m + 1)]


def double_delta_weights(width: int) -> list[float]:
    """Two half-length delta filters, one after the other."""
    half = delta_weights((width + 1) // 2)
    out = [0.0] * (2 * len(half) - 1)
    for i, a in enumerate(half):
        for j, b in enumerate(half):
            out[i + j] += a * b
    return out


def online_norm(series: DataFrame, by: str, order: list[str], value: str, alpha_mean: float, alpha_var: float) -> DataFrame:
    """Adds y: each value against its group's running mean and deviation, started at 0 and 1.

    The rule depends on order: rows come sorted to the task that owns the group and pass through in Arrow batches; two
    numbers are all that is held, so a group may be of any length."""
    rows = series.repartition(by).sortWithinPartitions(by, *order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, m, v = None, 0.0, 1.0
        for batch in batches:
            out = []
            for key, x in zip(batch[by].tolist(), batch[value].tolist(), strict=True):
                if key != now:
                    now, m, v = key, 0.0, 1.0
                m = (1 - alpha_mean) * m + alpha_mean * x
                v = (1 - alpha_var) * v + alpha_var * (x - m) * (x - m)
                out.append((x - m) / v**0.5)
            yield batch.assign(y=out)

    return rows.mapInPandas(fold, T.StructType([*[f for f in rows.schema.fields if f.name != "y"], T.StructField("y", T.DoubleType())]))


def online_norm_events(events: DataFrame, alpha_mean: float = 0.1, alpha_var: float = 0.1) -> DataFrame:
    """event_id, y: each user's values normalised as they come."""
    rows = events.select("user_id", "ts", "event_id", "value")
    return online_norm(rows, "user_id", ["ts", "event_id"], "value", alpha_mean, alpha_var).select("event_id", "y")


def islands(df: DataFrame, by: list[str], order: list[str], active: Column) -> DataFrame:
    """Runs of consecutive rows where `active` holds: by, island, first and last row number (0-based), n."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).where(active)
    rows = rows.withColumn("__g", F.col("__i") - F.row_number().over(Window.partitionBy(*by).orderBy("__i")))
    return rows.groupBy(*by, "__g").agg(F.min("__i").alias("start_frame"), F.max("__i").alias("end_frame"), F.count("*").alias("n")).drop("__g")


def bridged(runs: DataFrame, by: list[str], gap: int, least: int) -> DataFrame:
    """Runs joined over gaps of at most `gap` rows, then those of at least `least` rows."""
    w = Window.partitionBy(*by).orderBy("start_frame")
    new = F.coalesce((F.col("start_frame") - F.lag("end_frame").over(w) - 1 > gap).cast("int"), F.lit(1))
    rows = runs.withColumn("__g", F.sum(new).over(w))
    one = rows.groupBy(*by, "__g").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
    return one.where(F.col("end_frame") - F.col("start_frame") + 1 >= least).drop("__g")


def inside(frames: DataFrame, intervals: DataFrame, by: list[str], number: str, width: int = 64) -> DataFrame:
    """Frames that lie in a closed interval of their group: an equi-join on bins of `width` frames, then the exact test."""
    bins = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start_frame") / width), F.floor(F.col("end_frame") / width))))
    rows = frames.withColumn("__bin", F.floor(F.col(number) / width)).join(bins.select(*by, "__bin", "start_frame", "end_frame"), [*by, "__bin"])
    return rows.where(F.col(number).between(F.col("start_frame"), F.col("end_frame"))).drop("__bin")


#: The seven taps of the other double delta.
SEVEN_TAPS = [2.0, 1.0, -2.0, -2.0, -2.0, 1.0, 2.0]


def with_deltas(df: DataFrame, width: int, n: int) -> DataFrame:
    """Features, their deltas and their double deltas side by side."""
    weights, reach = [delta_weights(width), double_delta_weights(width)], (width - 1) // 2
    wide = len(weights[1]) // 2
    reach = max(reach, wide)
    rows = clamped(df, reach)
    value = lambda own, d: sum((F.lit(float(w)) * F.get(F.get("near", reach - len(own) // 2 + k), d) for k, w in enumerate(own) if w), F.lit(0.0))
    return rows.withColumn("features", F.concat("features", *[F.array(*[value(own, d) for d in range(n)]) for own in weights])).drop("near")


def ahead(df: DataFrame, k: int) -> DataFrame:
    """Adds `ahead`: the features k frames on, null near the end."""
    return df.withColumn("ahead", F.lead("features", k).over(in_order()))


def shuffled(rows: DataFrame, order: list[str], cache: int, seed: int, epoch: int) -> DataFrame:
    """Adds bucket and place: rows in buckets of `cache` neighbours, in an order drawn anew for each epoch.

    `number` is the row's place in the archive."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed + 12345 * epoch)), *[F.col(c).cast("string") for c in order]))
    rows = rows.withColumn("bucket", F.floor(F.col("number") / cache))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(key, *order)) - 1)


def counted(rows: DataFrame, by: str, order: list[str], value: str, width: int, slide: int) -> DataFrame:
    """by, start, n, mean: windows of `width` rows every `slide` rows; the last ones may hold fewer."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    own = rows.select(by, i.alias("i"), value)
    first = F.greatest(F.ceil((F.col("i") - width + 1) / slide), F.lit(0))
    own = own.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("i") / slide))))
    return own.groupBy(by, (F.col("w") * slide).alias("start")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def reflected(series: DataFrame, by: str, order: list[str], value: str, width: int, hop: int) -> DataFrame:
    """by, frame_no, centre, samples: a frame around every hop-th sample, the signal mirrored at both ends (without repeating the end).

    Signals shorter than half a frame repeat their ends."""
    w = Window.partitionBy(by).orderBy(*order)
    half = width // 2
    rows = series.select(by, (F.row_number().over(w) - 1).alias("__i"), F.col(value).alias("__v")).withColumn("__n", F.count("*").over(Window.partitionBy(by)))
    # A sample serves every frame that reaches it, itself or by its image beyond an end.
    images = F.array_distinct(F.array(F.col("__i"), -F.col("__i"), 2 * (F.col("__n") - 1) - F.col("__i")))
    spots = rows.withColumn("__at", F.explode(images)).where((F.col("__at") > -half - 1) & (F.col("__at") < F.col("__n") + width))
    frame = F.explode(F.sequence(F.ceil((F.col("__at") - (width - half) + 1) / hop), F.floor((F.col("__at") + half) / hop)))
    spots = spots.withColumn("frame_no", frame).where((F.col("frame_no") >= 0) & (F.col("frame_no") * hop < F.col("__n")))
    per = spots.groupBy(by, "frame_no").agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("__s"))
    return per.select(by, "frame_no", (F.col("frame_no") * hop).alias("centre"), F.transform("__s", lambda x: x["__v"]).alias("samples"))


def ranks_in_time(events: DataFrame, by: str, time: str) -> DataFrame:
    """Adds node: the place of each distinct time in its group's order, as a lattice numbers its nodes."""
    return events.withColumn("node", F.dense_rank().over(Window.partitionBy(by).orderBy(time)) - 1)
