"""Archive algebra: every operator takes and gives (seg_id, frame_no, features, label).

All but the joins of two archives work on one shuffle by segment at most; a chain of them keeps that partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import ranges
from framewright.operators.order import sums_before

KEYS = ["seg_id", "frame_no"]


def with_length(df: DataFrame, out: str = "n") -> DataFrame:
    return df.withColumn(out, F.count("*").over(Window.partitionBy("seg_id")).cast("int"))


def trim(df: DataFrame, first: int, last: int) -> DataFrame:
    """Drops frames at both ends (range `first:^last`) and renumbers."""
    return with_length(df).where((F.col("frame_no") >= first) & (F.col("frame_no") < F.col("n") - last)).withColumn("frame_no", F.col("frame_no") - first).drop("n")


def project(df: DataFrame, columns: list[int], field: str = "features") -> DataFrame:
    """Columns of the features (or of another array, such as labels) in the given order, with repeats."""
    return df.withColumn(field, F.array(*[F.get(field, i) for i in columns]))


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both archives frame by frame (all of a's columns, b's features as __f); a frame that only one of them has is an error."""
    left, right = a.withColumn("__a", F.lit(True)), b.select(*KEYS, F.col("features").alias("__f"), F.lit(True).alias("__b"))
    both = left.join(right, KEYS, "full")
    where = F.concat(F.lit("archives differ at segment "), F.col("seg_id").cast("string"), F.lit(", frame "), F.col("frame_no").cast("string"))
    fits = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(where).cast("boolean")).otherwise(F.lit(True))
    return both.where(fits).drop("__a", "__b")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features of both archives side by side, frame by frame."""
    return zipped(a, b).withColumn("features", F.concat("features", "__f")).drop("__f")


def with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of one archive beside labels (seg_id, frame_no, label) of another, frame by frame."""
    return zipped(features.drop("label"), labels.select(*KEYS, F.col("label").alias("features"))).withColumnRenamed("__f", "label")


def mismatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """seg_id and frame counts where two archives don't line up."""
    n = [x.groupBy("seg_id").agg(F.count("*").alias(c)) for x, c in ((a, "n_a"), (b, "n_b"))]
    return n[0].join(n[1], "seg_id", "full").where(~F.col("n_a").eqNullSafe(F.col("n_b")))


def diff(a: DataFrame, b: DataFrame, tolerance: float, first: bool = False) -> DataFrame:
    """seg_id, frame_no, column and both values where features differ by more than the tolerance; `first`: only the first such place."""
    both = zipped(a.select(*KEYS, "features"), b).select(*KEYS, F.col("features").alias("x"), F.col("__f").alias("y"))
    rows = both.select(*KEYS, F.posexplode(F.arrays_zip("x", "y")).alias("col", "v")).select(*KEYS, "col", F.col("v.x").alias("a"), F.col("v.y").alias("b"))
    rows = rows.where(F.abs(F.col("a") - F.col("b")) > tolerance)
    return rows.orderBy(*KEYS, "col").limit(1) if first else rows


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's segments after a's (ids offset by a's largest + 1); an error if their features aren't equally wide."""
    offset = a.agg((F.coalesce(F.max("seg_id"), F.lit(-1)) + 1).alias("__o"), F.max(F.size("features")).alias("__w"))  # one row
    moved = b.join(F.broadcast(offset)).withColumn("seg_id", F.col("seg_id") + F.col("__o"))
    fits = F.when(F.size("features") != F.col("__w"), F.raise_error(F.lit("archives of different widths")).cast("boolean")).otherwise(F.lit(True))
    return a.unionByName(moved.where(fits).drop("__o", "__w"))


#: Division by zero gives a signed infinity, 0/0 is not a number.
OPERATIONS = {
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y,
    "div": lambda x, y: F.when(y != 0, x / F.when(y != 0, y)).when((x == 0) | F.isnan(x), float("nan")).otherwise(F.signum(x) * float("inf")),
}


def arithmetic(archives: list[DataFrame], gains: list[float], operations: list[str], plus: float = 0.0) -> DataFrame:
    """g1 a (op) g2 b (op) ... + plus, from left to right, feature by feature, over any number of archives of equal frames."""
    rows = archives[0].withColumn("features", F.transform("features", lambda x: x * gains[0]))
    for other, gain, op in zip(archives[1:], gains[1:], operations, strict=True):
        scaled = F.transform("__f", lambda x: x * gain)  # noqa: B023
        rows = zipped(rows, other).withColumn("features", F.zip_with("features", scaled, OPERATIONS[op])).drop("__f")
    return rows.withColumn("features", F.transform("features", lambda x: x + plus))


def combo(a: DataFrame, b: DataFrame, op: str, scale_a: float = 1.0, scale_b: float = 1.0, plus: float = 0.0) -> DataFrame:
    """scale_a * a (op) scale_b * b + plus, feature by feature."""
    return arithmetic([a, b], [scale_a, scale_b], [op], plus)


def patch_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels replaced by those of (seg_id, frame_no, label) where there is one."""
    return df.join(labels.select(*KEYS, F.col("label").alias("__l")), KEYS, "left").withColumn("label", F.coalesce("__l", "label")).drop("__l")


def _reindex(df: DataFrame, target: Column) -> DataFrame:
    """For each frame number of the array `target` (of n), the frame it names after clamping to the segment, renumbered."""
    rows = with_length(df)
    heads = rows.where("frame_no = 0").select("seg_id", F.posexplode(target).alias("__to", "__from"), "n")
    heads = heads.select("seg_id", "__to", F.least(F.greatest("__from", F.lit(0)), F.col("n") - 1).alias("frame_no"))
    return heads.join(df, KEYS).drop("frame_no").withColumnRenamed("__to", "frame_no")


def pad(df: DataFrame, n: int) -> DataFrame:
    """Edge frames repeated n times."""
    return _reindex(df, F.sequence(F.lit(-n), F.col("n") - 1 + n))


def set_length(df: DataFrame, length: Column) -> DataFrame:
    """Segments cut to a length (an expression of seg_id and n) or filled up with their last frame."""
    return _reindex(df, F.sequence(F.lit(0), length - 1))


def skip(df: DataFrame, count: Column) -> DataFrame:
    """The first frames of each segment dropped, the rest renumbered."""
    return df.where(F.col("frame_no") >= count).withColumn("frame_no", F.col("frame_no") - count)


def repeat(df: DataFrame, n: int) -> DataFrame:
    """Each segment n times in a row: segment s becomes n*s ... n*s + n - 1."""
    return df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("seg_id", F.col("seg_id") * n + F.col("__k")).drop("__k")


def merge_segments(df: DataFrame) -> DataFrame:
    """All segments as one, numbered through; what lies before a segment is summed by ranges, so no task sees all of them."""
    sizes = df.groupBy("seg_id").agg(F.count("*").alias("n"))
    starts = sums_before(sizes, [], ["seg_id"], "n", "__start").select("seg_id", "__start")
    return df.join(starts, "seg_id").withColumn("frame_no", F.col("frame_no") + F.col("__start")).withColumn("seg_id", F.lit(0).cast("long")).drop("__start")


def info(df: DataFrame) -> DataFrame:
    """One row: segments, frames, feature and longest-segment sizes."""
    per = df.groupBy("seg_id").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("w"))
    return per.agg(F.count("*").alias("n_segs"), F.sum("n").alias("n_frames"), F.max("w").cast("long").alias("n_features"), F.max("n").alias("longest"))


def contiguous(df: DataFrame, first: int, last: int) -> DataFrame:
    """Segments first..last, renumbered from 0."""
    return df.where(F.col("seg_id").between(first, last)).withColumn("seg_id", F.col("seg_id") - first)


def segments_in_order(df: DataFrame, spec: str, n: int) -> DataFrame:
    """The segments that a range names among 0..n-1, in its order and with its repeats: `place` (item, k) sorts them."""
    return df.withColumn("place", F.explode(ranges.named(F.col("seg_id").cast("long"), F.lit(n).cast("long"), spec)))


def frames_in_order(df: DataFrame, spec: str) -> DataFrame:
    """The frames that a range names in each segment (`^k` from its own end), in its order and with its repeats, renumbered."""
    rows = with_length(df).withColumn("__place", F.explode(ranges.named(F.col("frame_no").cast("long"), F.col("n").cast("long"), spec)))
    order = F.row_number().over(Window.partitionBy("seg_id").orderBy("__place")) - 1
    return rows.withColumn("frame_no", order).drop("n", "__place")


def split(df: DataFrame, spec: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The segments that a range names (to be held out), and the others."""
    held = F.size(ranges.named(F.col("seg_id").cast("long"), F.lit(n).cast("long"), spec)) > 0
    return df.where(held), df.where(~held)


def columns_apart(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and labels as archives of their own."""
    return df.select(*KEYS, "features"), df.select(*KEYS, "label")


def accepted(df: DataFrame, classes: int) -> DataFrame:
    """Frames whose label is a class; the label behind the last class means reject."""
    return df.where(F.col("label") < classes)


def downsample(df: DataFrame, step: int) -> DataFrame:
    """Every step-th frame, renumbered."""
    return df.where(F.col("frame_no") % step == 0).withColumn("frame_no", F.floor(F.col("frame_no") / step))


def trajectory(df: DataFrame, column: int) -> DataFrame:
    """One feature of each segment as an array over time."""
    pairs = F.array_sort(F.collect_list(F.struct("frame_no", F.get("features", column).alias("v"))))
    return df.groupBy("seg_id").agg(F.transform(pairs, lambda x: x["v"]).alias("values"))


def frame_info(df: DataFrame, epochs: int) -> DataFrame:
    """epoch, seg_id, frame_no, n, last: what a training loop sees of each frame in each pass."""
    rows = with_length(df).select(*KEYS, "n", (F.col("frame_no") == F.col("n") - 1).alias("last"))
    return rows.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "*")


def adjacent_distinct(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows but those whose value equals the one just before in their group."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumn("__same", ~first & before.eqNullSafe(F.col(value))).where("NOT __same").drop("__same")


def with_content(headers: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Headers that have rows under them."""
    return headers.join(rows.select(key).distinct(), key, "left_semi")


def noise(number: Column, seed: int) -> Column:
    """A value near a standard normal that only depends on a text that names it: eight 16-bit parts of its digest added up, with mean 0 and deviation 1."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), number))
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.conv(F.substr(digest, 4 * k + 1, F.lit(4)), 16, 10).cast("double") + 0.5) / 65536)
    return (F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) - 4) * math.sqrt(1.5)


def with_silence(df: DataFrame, width: int, before: int, after: int, frames: int, mean: tuple[float, float] = (1.0, 0.0), deviation: tuple[float, float] = (1.0, 0.0), seed: int = 1) -> DataFrame:
    """Segments (seg_id, frame_no, features, label) with `before` made-up frames ahead and `after` behind.

    A made-up frame is noise around the mean of the segment's first (last) `frames` frames with their population deviation, both
    scaled and shifted as given: (factor, plus).  It takes the label of the segment's first (last) frame.  Statistics are one
    aggregate a segment and noise a rule of segment, place and column, so a rerun makes the same frames; segments stay whole in no task."""
    n = F.col("__n")
    rows = df.join(df.groupBy("seg_id").agg((F.max("frame_no") + 1).alias("__n")), "seg_id")

    def made(count: int, of: Column, at: Column, side: str) -> DataFrame:
        own = [F.get("features", i) for i in range(width)]
        average = F.array(*[F.avg(x) for x in own])
        spread = F.array(*[F.stddev_pop(x) for x in own])
        picked = F.min_by("label", "frame_no") if side == "before" else F.max_by("label", "frame_no")
        stats = rows.where(of).groupBy("seg_id", "__n").agg(average.alias("__m"), spread.alias("__s"), picked.alias("label"))
        each = stats.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        value = F.transform(F.arrays_zip("__m", "__s"), lambda z, i: mean[0] * z["__m"] + mean[1] + (deviation[0] * z["__s"] + deviation[1]) * noise(F.concat_ws(":", F.col("seg_id").cast("string"), F.lit(side), F.col("__k").cast("string"), i.cast("string")), seed))
        return each.select("seg_id", (at + F.col("__k")).cast("long").alias("frame_no"), value.alias("features"), "label")

    out = df.select("seg_id", (F.col("frame_no") + before).cast("long").alias("frame_no"), "features", "label")
    if before:
        out = out.unionByName(made(before, F.col("frame_no") < frames, F.lit(0), "before"))
    if after:
        out = out.unionByName(made(after, F.col("frame_no") >= n - frames, n + before, "after"))
    return out
