"""Repeated-pattern discovery on a sparse match matrix: dots, median filter, Hough rows, peaks, runs.

Dots are (file, yp, xp, val) in rotated coordinates of a self-comparison: xp = i + j, yp = j - i."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.graph import written
from framewright.operators.order import paired


def dots(frames: DataFrame, bits: int, threshold: float) -> DataFrame:
    """Dots of every file against itself, above the diagonal; frames: file, frame_no, sig."""
    from framewright.operators.lsh import cosine, hamming

    i, j = F.col("a.frame_no"), F.col("b.frame_no")
    rows = paired(frames.select("file", "frame_no", "sig"), ["file"], "frame_no").select("file", (j - i).alias("yp"), (i + j).alias("xp"), cosine(hamming(F.col("a.sig"), F.col("b.sig")), bits).alias("val"))
    return rows.where(F.col("val") > threshold)


def median_filter(cells: DataFrame, dx: int, share: float = 0.5) -> DataFrame:
    """file, yp, xp where more than int(share * (2 dx + 1) / 2) dots of the row lie within dx; fills gaps and drops loners."""
    need = int(share * (2 * dx + 1) / 2)
    near = cells.select("file", "yp", F.explode(F.sequence(F.col("xp") - dx, F.col("xp") + dx)).alias("xp"))
    return near.groupBy("file", "yp", "xp").agg(F.count("*").alias("n")).where(F.col("n") > need)


def kernel(dy: int) -> list[float]:
    """Gaussian taps at -dy .. dy."""
    return [3 / dy / math.sqrt(2 * math.pi) * math.exp(-((3 * k / dy) ** 2) / 2) for k in range(-dy, dy + 1)]


def hough(cells: DataFrame, dy: int) -> DataFrame:
    """file, yp, h: dots of each row, smoothed over neighbouring rows."""
    return smoothed(cells.groupBy("file", "yp").agg(F.count("*").alias("n")), dy)


def smoothed(counts: DataFrame, dy: int) -> DataFrame:
    """file, yp, h of the number n of dots of each row."""
    taps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-dy, dy + 1), kernel(dy), strict=True)])).alias("t")
    return counts.select("file", "yp", "n", taps).groupBy("file", (F.col("yp") + F.col("t.k")).alias("yp")).agg(F.sum(F.col("n") * F.col("t.w")).alias("h"))


def peaks(rows: DataFrame, least: float) -> DataFrame:
    """Strict local maxima above `least`; a row that isn't there counts as 0."""
    w = Window.partitionBy("file").orderBy("yp")
    side = lambda k: F.when(F.lag("yp", k).over(w) == F.col("yp") - k, F.lag("h", k).over(w)).otherwise(0.0)
    marked = rows.withColumns({"__a": side(1), "__b": side(-1)})
    return marked.where((F.col("h") > least) & (F.col("h") > F.col("__a")) & (F.col("h") > F.col("__b"))).select("file", "yp", "h")


def runs(cells: DataFrame, rho: DataFrame, dy: int, longer: int, active: float = 0.1) -> DataFrame:
    """Matches: unbroken stretches of xp around a peak row where the weighted dots exceed `active`, longer than `longer`.

    Returns file, yp and the matched frames x_a..x_b and y_a..y_b (rotation undone, halves cut towards zero)."""
    taps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-dy, dy + 1), kernel(dy), strict=True)])).alias("t")
    spread = cells.select("file", "yp", "xp", taps).select("file", (F.col("yp") + F.col("t.k")).alias("yp"), "xp", F.col("t.w").alias("w"))
    band = spread.join(rho.select("file", "yp"), ["file", "yp"]).groupBy("file", "yp", "xp").agg(F.sum("w").alias("a")).where(F.col("a") > active)
    w = Window.partitionBy("file", "yp").orderBy("xp")
    one = band.withColumn("g", F.col("xp") - F.row_number().over(w)).groupBy("file", "yp", "g").agg(F.min("xp").alias("lo"), F.max("xp").alias("hi"))
    return spans(one, longer)


def spans(rows: DataFrame, longer: int) -> DataFrame:
    """Stretches lo..hi of a row as matched frames, those longer than `longer`."""
    half = lambda x: (x / 2).cast("int")
    return rows.where(F.col("hi") - F.col("lo") + 1 > longer).select(
        "file", "yp", half(F.col("lo") - F.col("yp")).alias("xa"), half(F.col("hi") - F.col("yp")).alias("xb"), half(F.col("lo") + F.col("yp")).alias("ya"), half(F.col("hi") + F.col("yp")).alias("yb")
    )


# ---------------------------------------------------------------- the same from frames, without a table of dots


class Squares:
    """The match matrices of files in pieces of `width` frames (i) times `width` rows (yp = j - i), computed where they are used.

    A piece sees the frames i and j of its own and of a margin around it, so the median filter and the bands of rows (`dy` to each
    side) come out whole; of the dots nothing is stored or shuffled, and a task holds one piece in strips of `STRIP` cells.  A file
    of n frames is (n / width)^2 / 2 pieces, and a frame travels to about 4 n / width of them.

    frames: file, frame_no, sig; a frame number may be missing or have several signatures, whose dots all count."""

    STRIP = 1 << 19

    def __init__(self, frames: DataFrame, bits: int, threshold: float, dx: int, dy: int, share: float = 0.5, width: int = 4_096):
        self.frames = written(frames.where("file IS NOT NULL AND frame_no IS NOT NULL AND sig IS NOT NULL").select("file", "frame_no", "sig"))
        self.bits, self.dx, self.dy, self.width = bits, dx, dy, width
        self.need = int(share * (2 * dx + 1) / 2)
        self.near = [h for h in range(bits + 1) if math.cos(math.pi * h / bits) > threshold]
        self.rim = dx // 2 + 1 + (dy + 1) // 2
        self.file = frames.schema["file"].dataType.simpleString()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "frames"}  # tasks get theirs as groups

    def dealt(self, rows: DataFrame | None = None) -> DataFrame:
        """file, ib, yb (the piece), side, place, sig: frames i (side 0) and j (side 1), and rows asked for (file, yp) as side 2."""
        w, rim, f = self.width, self.rim, F.col("frame_no")
        reached = F.array_distinct(F.array(F.floor((f - rim) / w), F.floor((f + rim) / w)))
        a = self.frames.select("file", "frame_no", "sig", F.explode(reached).alias("ib"))
        blocks = written(a.select("file", "ib").distinct())
        low = F.greatest(F.floor((f - F.col("ib") * w - rim) / w) - 1, F.lit(0))
        high = F.floor((f - F.col("ib") * w + rim + 2 * self.dy) / w)
        b = self.frames.join(blocks, "file").where(high >= low).select("file", "frame_no", "sig", "ib", F.explode(F.sequence(low, high)).alias("yb"))
        pieces = written(b.select("file", "ib", "yb").distinct())
        out = a.join(pieces, ["file", "ib"]).select("file", "ib", "yb", F.lit(0).alias("side"), f.cast("long").alias("place"), "sig")
        out = out.union(b.select("file", "ib", "yb", F.lit(1), f.cast("long"), "sig"))
        if rows is not None:
            own = rows.select("file", "yp", F.floor((F.col("yp") + self.dy) / w).alias("yb")).join(pieces, ["file", "yb"])
            out = out.union(own.select("file", "ib", "yb", F.lit(2), F.col("yp").cast("long"), F.lit(0).cast("long")))
        parts = min(max(1, pieces.count()), max(200, int(self.frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        return out.repartition(parts, "file", "ib", "yb").groupBy("file", "ib", "yb")

    def layers(self, places: np.ndarray, sigs: np.ndarray, first: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Signatures by place from `first` on and where there are any; as many layers as a place has signatures."""
        there = (places >= first) & (places < first + n)
        at = np.argsort(places[there], kind="stable")
        places, sigs = places[there][at] - first, sigs[there][at]
        rank = np.arange(len(places)) - np.searchsorted(places, places)
        out = []
        for k in range(int(rank.max(initial=0)) + 1):
            values, mask = np.zeros(n, np.uint32 if self.bits <= 32 else np.uint64), np.zeros(n, bool)
            values[places[rank == k]], mask[places[rank == k]] = sigs[rank == k], True
            out.append((values, mask))
        return out

    def strips(self, group: pd.DataFrame, ib: int, yb: int, more: int):
        """For strips of the piece's rows, i0 and (y, even, odd): the cells that the median filter keeps, of rows y (`more` to each side of
        the strip's own) and of frames from i0 - (more + 1) // 2 on; even cells are at xp = 2 i + y, odd ones at 2 i + 1 + y."""
        w, dx, rim = self.width, self.dx, self.rim
        side, place = group["side"].to_numpy(), group["place"].to_numpy()
        sig = group["sig"].to_numpy().astype(np.uint64)
        i, j = place[side == 0], place[side == 1]
        i0, i1 = max(ib * w, int(i.min()) - rim), min(ib * w + w, int(i.max()) + rim + 1)
        y0, y1 = yb * w - self.dy, yb * w + w - self.dy
        y0, y1 = max(y0, 1 - more, int(j.min()) - int(i.max()) - more), min(y1, int(j.max()) - int(i.min()) + more + 1)
        if i0 >= i1 or y0 >= y1:
            return
        side_i, h = (more + 1) // 2, dx // 2 + 1
        first, n = i0 - side_i - h, i1 - i0 + 2 * (side_i + h)
        m = n - 2 * h
        above = self.layers(i, sig[side == 0], first, n)
        beside = self.layers(j, sig[side == 1], first + y0 - more, n + y1 - y0 + 2 * more)
        view = np.lib.stride_tricks.sliding_window_view
        beside = [(view(x, n), view(t, n)) for x, t in beside]
        step = max(1, self.STRIP // n)
        for y in range(y0, y1, step):
            a, b = y - y0, min(y + step, y1) - y0 + 2 * more
            p = 0
            for x, t in above:
                for u, v in beside:
                    dots = (np.bitwise_count(x ^ u[a:b]) < len(self.near)) & (t & v[a:b])
                    p = dots.view(np.uint8) if len(above) == len(beside) == 1 else p + dots.astype(np.int32)
            p[: max(0, 1 - (y - more))] = 0  # j is after i
            reach = lambda low, high: sum((p[:, h + k : h + k + m] for k in range(low + 1, high + 1)), start=p[:, h + low : h + low + m]) > self.need
            even = reach(-(dx // 2), dx // 2)
            odd = reach(-((dx - 1) // 2), (dx + 1) // 2) if dx else np.zeros_like(even)
            yield i0, i1, np.arange(y - more, y - more + b - a), even, odd

    def counts(self) -> DataFrame:
        """file, yp, n: the cells of each row that the median filter keeps."""

        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            ys, ns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if (group["side"] == 0).any() and (group["side"] == 1).any():
                for _, _, y, even, odd in self.strips(group, key[1], key[2], 0):
                    ys.append(y)
                    ns.append(np.count_nonzero(even, axis=1) + np.count_nonzero(odd, axis=1))
            out = pd.DataFrame({"yp": np.concatenate(ys), "n": np.concatenate(ns)})
            out.insert(0, "file", key[0])
            return out[out["n"] > 0]

        parts = self.dealt().applyInPandas(run, f"file {self.file}, yp long, n long")
        return parts.groupBy("file", "yp").agg(F.sum("n").alias("n"))

    def runs(self, rho: DataFrame, longer: int, active: float = 0.1) -> DataFrame:
        """As `runs`, around the peak rows rho (file, yp)."""
        dy, taps = self.dy, kernel(self.dy)

        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            got = [np.zeros((0, 4), np.int64)]
            asked = np.unique(group["place"].to_numpy()[group["side"].to_numpy() == 2])
            if len(asked) and (group["side"] == 0).any() and (group["side"] == 1).any():
                for i0, i1, y, even, odd in self.strips(group, key[1], key[2], dy):
                    at = np.searchsorted(y, asked[(asked >= y[dy]) & (asked <= y[-1 - dy])])
                    if not len(at):
                        continue
                    cells = np.empty((len(y), 2 * even.shape[1]), np.float64)
                    cells[:, 0::2], cells[:, 1::2] = even, odd
                    start, n = 2 * ((dy + 1) // 2), 2 * (i1 - i0)
                    band = sum(w * cells[at - k, start + k : start + k + n] for k, w in zip(range(-dy, dy + 1), taps, strict=True))
                    edge = np.zeros((len(at), n + 2), np.int8)
                    edge[:, 1:-1] = band > active
                    turn = np.diff(edge, axis=1)
                    (r, lo), (_, hi) = np.nonzero(turn == 1), np.nonzero(turn == -1)
                    cut = (lo == 0) | (hi == n)
                    keep = cut | (hi - lo > longer)
                    r, lo, hi, cut = r[keep], lo[keep], hi[keep], cut[keep]
                    yp = y[at[r]]
                    got.append(np.column_stack((yp, 2 * i0 + yp + lo, 2 * i0 + yp + hi - 1, cut)))
            out = pd.DataFrame(np.concatenate(got), columns=["yp", "lo", "hi", "cut"])
            out.insert(0, "file", key[0])
            return out

        found = written(self.dealt(rho).applyInPandas(run, f"file {self.file}, yp long, lo long, hi long, cut long"))
        w = Window.partitionBy("file", "yp").orderBy("lo")
        fresh = F.coalesce((F.col("lo") - F.lag("hi").over(w) > 1).cast("int"), F.lit(1))
        joined = found.where("cut = 1").withColumn("__new", fresh).withColumn("g", F.sum("__new").over(w)).groupBy("file", "yp", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return spans(found.where("cut = 0").select("file", "yp", "lo", "hi").union(joined.select("file", "yp", "lo", "hi")), longer)

