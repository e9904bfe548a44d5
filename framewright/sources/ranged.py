"""Files of fixed-width rows, read in ranges: a file is as many partitions as its size asks for.

`format("framewright-ranges")` reads archives, raw and self-sized matrices, signatures,
feature files with a 12-byte header, rows with an end-of-segment flag (8-bit codes or numbers) and PCM sound.  A partition is a range of rows of one
file; in archives with an index it is a range of whole segments, unless one segment alone is
longer than a partition.  Options give segments (a range list like `3-9,20`) and frames (first and
last of each segment), and filters of the DataFrame on seg_id and frame_no come down too: segments
that the index rules out are no partition, and of the others only the bytes of the asked frames
are read.  A task holds one batch of rows, however large the file; of more than TASKS ranges (many small files) a task reads several.

The driver reads headers and indexes only (four bytes for each segment).  An archive without an
index is read by rows, with the same result.  Empty files and files without rows give none; a
truncated file is an error that names it.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from framewright.functions.ranges import parse
from framewright.sources.files import HEADER, archive_fields
from framewright.sources.stores import found, opened

NAME = "framewright-ranges"
#: Bytes of a partition, and rows of a batch.
PART_BYTES, BATCH = 64 << 20, 10_000
#: Partitions at most; more ranges than these share them.
TASKS = 500
SCHEMAS = {
    "archive": "path string, seg_id bigint, frame_no bigint, features array<double>, labels array<bigint>",
    "signatures": "path string, frame_no bigint, sig bigint",
    "flagged": "path string, frame_no bigint, ended boolean, features array<double>",
    "sound": "path string, rate bigint, frame_no bigint, channels array<double>",
}
MATRIX = "path string, frame_no bigint, features array<double>"
KINDS = ("archive", "raw", "sized", "htk", "signatures", "flagged", "sound")


@dataclass
class Layout:
    """Where the rows of a file lie, and the cells of each."""

    offset: int
    rows: int
    cell: str  # numpy type of a cell
    cells: int
    fields: dict = field(default_factory=dict)
    starts: np.ndarray | None = None  # row at which each segment begins, and the number of rows

    @property
    def width(self) -> int:
        return np.dtype(self.cell).itemsize * self.cells


def layout(kind: str, uri: str, size: int, options: dict) -> Layout:
    """From a file's header (and the index of an archive)."""
    if kind == "raw" and size:  # has no header to open it for
        out = Layout(int(options.get("skip", 0)), 0, options.get("dtype", "<f4"), int(options["width"]))
        out.rows, rest = divmod(size - out.offset, out.width)
        if rest:
            raise ValueError(f"{uri}: {size - out.offset} bytes aren't rows of {out.cells}")
        return out
    if size == 0:
        return Layout(0, 0, "u1", 1)
    system, path = opened(uri)
    with system.open_input_file(path) as f:

        def at(where: int, n: int) -> bytes:
            got = f.read_at(n, where)
            if len(got) < n:
                raise ValueError(f"{uri} ends at byte {size}, before {where + n}")
            return got

        if kind == "archive":
            h = archive_fields(at(0, HEADER))
            out = Layout(HEADER, h["num_frames"], ">u4", 2 + h["num_features"] + h["num_labels"], h)
            index = HEADER + out.rows * out.width
            if size >= index + 4 * (h["num_sentences"] + 1):
                out.starts = np.frombuffer(at(index, 4 * (h["num_sentences"] + 1)), ">u4").astype(np.int64)
        elif kind == "sized":
            out = Layout(4, 0, "<f4", struct.unpack("<i", at(0, 4))[0])
            out.rows = (size - 4) // out.width
        elif kind == "htk":
            n, _, width, _ = struct.unpack(">iihh", at(0, 12))
            out = Layout(12, n, ">f4", width // 4)
        elif kind == "signatures":
            out = Layout(0, size // 8, "<i8", 1)
        elif kind == "flagged":
            out = Layout(0, 0, "u1", 1 + int(options["width"]) * np.dtype(options.get("dtype", "u1")).itemsize, {"dtype": options.get("dtype", "u1")})
            out.rows, rest = divmod(size, out.width)
            if rest:
                raise ValueError(f"{uri}: {size} bytes aren't rows of a flag and {options['width']} values")
        else:
            out = sound(at, size, uri)
    if out.offset + out.rows * out.width > size:
        raise ValueError(f"{uri} ends at byte {size}, before its {out.rows} rows")
    return out


def sound(at, size: int, uri: str) -> Layout:
    """Of a RIFF or `.snd` file of 8- or 16-bit samples."""
    magic = at(0, 4)
    if magic == b".snd":
        _, offset, length, coding, rate, channels = struct.unpack(">4sIIIII", at(0, 24))
        if coding not in (2, 3):
            raise ValueError(f"{uri}: coding {coding} isn't PCM")
        out = Layout(offset, 0, "i1" if coding == 2 else ">i2", channels, {"rate": rate})
        out.rows = (min(length, size - offset) if length != 0xFFFFFFFF else size - offset) // out.width
        return out
    place, fmt = 12, None
    while magic == b"RIFF" and place + 8 <= size:
        name, length = struct.unpack("<4sI", at(place, 8))
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", at(place + 8, 16))
        elif name == b"data" and fmt:
            out = Layout(place + 8, 0, "u1" if fmt[5] == 8 else "<i2", fmt[1], {"rate": fmt[2]})
            out.rows = min(length, size - place - 8) // out.width
            return out
        place += 8 + length + length % 2
    raise ValueError(f"{uri}: no sound data")


@dataclass
class Part(ds.InputPartition):
    """Stretches of rows (first, one past the last) of one file, with the frame number of the first where no column holds it."""

    uri: str
    shape: Layout
    stretches: list[tuple[int, int]]
    segments: frozenset[int] | None = None  # of an archive without an index, whose rows are asked one by one
    frames: tuple[int, float] = (0, math.inf)


@dataclass
class Lot(ds.InputPartition):
    """Several ranges that one task reads one after the other."""

    parts: list[Part]


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in stretches:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def parts(uri: str, shape: Layout, rows: int, segments: set[int] | None, frames: tuple[int, float]) -> Iterator[Part]:
    """Partitions of at most `rows` rows (by whole segments where the index tells them) of the asked segments and frames."""
    plain = Layout(shape.offset, shape.rows, shape.cell, shape.cells, shape.fields)
    if shape.starts is None:
        if "num_frames" in shape.fields:
            for a in range(0, shape.rows, rows):
                yield Part(uri, plain, [(a, min(a + rows, shape.rows))], None if segments is None else frozenset(segments), frames)
            return
        first, last = min(frames[0], shape.rows), int(min(frames[1] + 1, shape.rows))
        for a in range(first, last, rows):
            yield Part(uri, plain, [(a, min(a + rows, last))])
        return
    held, n = [], 0
    for s in range(len(shape.starts) - 1) if segments is None else sorted(x for x in segments if 0 <= x < len(shape.starts) - 1):
        begin, end = int(shape.starts[s]), int(shape.starts[s + 1])
        a, b = min(begin + frames[0], end), int(min(begin + frames[1] + 1, end))
        if held and n + b - a > rows:
            yield Part(uri, plain, merged(held))
            held, n = [], 0
        for k in range(a, b, rows):  # a segment that is longer than a partition is cut
            if held and n + min(rows, b - k) > rows:
                yield Part(uri, plain, merged(held))
                held, n = [], 0
            held.append((k, min(k + rows, b)))
            n += held[-1][1] - k
    if held:
        yield Part(uri, plain, merged(held))


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kind = options, options["kind"]
        self.bounds = {"seg_id": [0, math.inf], "frame_no": [int(options.get("first", 0)), float(options.get("last", math.inf))]}
        self.segments: set[int] | None = None

    def pushFilters(self, filters: list) -> Iterator:
        """Takes note of bounds on seg_id and frame_no; Spark still applies every filter, so a bound need only not be too narrow."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            whole = isinstance(getattr(f, "value", None), int) and not isinstance(f.value, bool)
            if column in self.bounds:
                low = {ds.EqualTo: 0, ds.GreaterThanOrEqual: 0, ds.GreaterThan: 1}.get(type(f))
                high = {ds.EqualTo: 0, ds.LessThanOrEqual: 0, ds.LessThan: -1}.get(type(f))
                if low is not None and whole:
                    self.bounds[column][0] = max(self.bounds[column][0], f.value + low)
                if high is not None and whole:
                    self.bounds[column][1] = min(self.bounds[column][1], f.value + high)
                if isinstance(f, ds.In) and all(isinstance(v, int) for v in f.value):
                    self.bounds[column][0] = max(self.bounds[column][0], min(f.value, default=0))
                    self.bounds[column][1] = min(self.bounds[column][1], max(f.value, default=-1))
                    if column == "seg_id":
                        self.segments = set(f.value) & (self.segments if self.segments is not None else set(f.value))
            yield f

    def partitions(self) -> list[Part]:
        rows_of = lambda shape: max(1, int(self.options.get("part_bytes", PART_BYTES)) // shape.width)
        out = []
        for uri, size in json.loads(self.options["files"]):
            shape = layout(self.kind, uri, size, self.options)
            chosen = self.segments
            if self.kind == "archive" and (listed := self.options.get("segments")):
                asked = set(parse(listed, shape.fields["num_sentences"]))
                chosen = asked if chosen is None else chosen & asked
            low, high = self.bounds["seg_id"]
            if self.kind == "archive" and shape.starts is not None and (low > 0 or high < math.inf):
                every = range(max(0, int(low)), int(min(high + 1, len(shape.starts) - 1)))
                chosen = set(every) if chosen is None else chosen & set(every)
            if shape.rows:
                out += parts(uri, shape, rows_of(shape), chosen, tuple(self.bounds["frame_no"]))
        if len(out) > TASKS:  # many small files: ranges stay what they are, a task reads several
            return [Lot(out[k * len(out) // TASKS : (k + 1) * len(out) // TASKS]) for k in range(TASKS)]
        return out or [Part("", Layout(0, 0, "u1", 1), [])]

    def __getstate__(self) -> dict:
        """What tasks need, which have their ranges: not the list of all files."""
        return self.__dict__ | {"options": {k: v for k, v in self.options.items() if k != "files"}}

    def read(self, part: Part | Lot) -> Iterator[pa.RecordBatch]:
        """Batches of at most BATCH rows; those of small ranges are put together."""
        held, n = [], 0
        for batch in (b for p in (part.parts if isinstance(part, Lot) else [part]) for b in self.rows(p)):
            if held and n + batch.num_rows > BATCH:
                yield pa.concat_batches(held)
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if held:
            yield pa.concat_batches(held)

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.uri:
            return
        system, path = opened(part.uri)
        shape = part.shape
        with system.open_input_file(path) as f:
            for first, last in part.stretches:
                for a in range(first, last, BATCH):
                    n = min(BATCH, last - a)
                    raw = f.read_at(n * shape.width, shape.offset + a * shape.width)
                    cells = np.frombuffer(raw, shape.cell, count=n * shape.cells).reshape(n, shape.cells)
                    if self.kind == "archive" and (part.segments is not None or part.frames != (0, math.inf)):
                        mine = (cells[:, 1] >= part.frames[0]) & (cells[:, 1] <= part.frames[1])
                        cells = cells[mine & np.isin(cells[:, 0], sorted(part.segments))] if part.segments is not None else cells[mine]
                    if len(cells):
                        yield self.batch(part.uri, shape, a, cells)

    def batch(self, uri: str, shape: Layout, first: int, cells: np.ndarray) -> pa.RecordBatch:
        n = len(cells)
        numbers = pa.array(np.arange(first, first + n))
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if x.shape[1] else np.zeros(n + 1, np.int32)), pa.array(x.reshape(-1).astype(kind)))
        columns: dict = {"path": pa.array([uri] * n)}
        if self.kind == "archive":
            h = shape.fields
            a, b = h.get("first_feature_column", 2), h.get("first_label_column", 2 + h["num_features"])
            features = np.ascontiguousarray(cells[:, a : a + h["num_features"]]).view(">f4")
            columns |= {"seg_id": pa.array(cells[:, 0].astype(np.int64)), "frame_no": pa.array(cells[:, 1].astype(np.int64)), "features": lists(features, np.float64), "labels": lists(cells[:, b : b + h["num_labels"]], np.int64)}
        elif self.kind == "signatures":
            columns |= {"frame_no": numbers, "sig": pa.array(cells[:, 0].astype(np.int64))}
        elif self.kind == "flagged":
            x = np.ascontiguousarray(cells[:, 1:]).view(shape.fields["dtype"])
            columns |= {"frame_no": numbers, "ended": pa.array(cells[:, 0] >= 128), "features": lists(x, np.float64)}
        elif self.kind == "sound":
            x = cells.astype(np.float64) - (128 if shape.cell == "u1" else 0)
            columns |= {"rate": pa.array(np.full(n, shape.fields["rate"], np.int64)), "frame_no": numbers, "channels": lists(x, np.float64)}
        else:
            columns |= {"frame_no": numbers, "features": lists(cells, np.float64)}
        return pa.RecordBatch.from_pydict(columns)


class Ranges(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS.get(self.options["kind"], MATRIX)

    def reader(self, schema) -> Reader:
        self.planned = True
        return Reader(dict(self.options))

    def __getstate__(self) -> dict:
        """Once its reader is made, tasks get the source without the list of files."""
        return self.__dict__ | ({"options": {k: v for k, v in self.options.items() if k != "files"}} if getattr(self, "planned", False) else {})


def scan(spark: SparkSession, kind: str, path: str | list[str], **options) -> DataFrame:
    """The rows of all files that the paths name.  options: segments, first, last, part_bytes; width, dtype and skip for raw matrices, width and dtype for flagged rows.

    Filters reach the files only with Spark's setting for filters in Python sources, which this turns on for the session."""
    if kind not in KINDS:
        raise ValueError(f"no rows of kind {kind!r}; there are {', '.join(KINDS)}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Ranges)
    reader = spark.read.format(NAME).options(kind=kind, files=json.dumps(found(spark, path)), **{k: str(v) for k, v in options.items() if v is not None})
    return reader.load()


def segmented(rows: DataFrame, block: int = 65_536) -> DataFrame:
    """path, seg_id, frame_no, features of flagged rows: segments are numbered by the flags before them.  Flags are counted by blocks of rows, so no file is ordered by a task."""
    rows = rows.withColumn("__b", F.floor(F.col("frame_no") / block))
    last = F.when(F.col("ended"), F.col("frame_no"))
    sums = rows.groupBy("path", "__b").agg(F.sum(F.col("ended").cast("long")).alias("__n"), F.max(last).alias("__last"))  # a row for each block
    sooner = Window.partitionBy("path").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("path", "__b", F.coalesce(F.sum("__n").over(sooner), F.lit(0)).alias("__n"), F.coalesce(F.max("__last").over(sooner), F.lit(-1)).alias("__last"))
    inside = Window.partitionBy("path", "__b").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__k": F.coalesce(F.sum(F.col("ended").cast("long")).over(inside), F.lit(0)), "__l": F.max(last).over(inside)}).join(before, ["path", "__b"])
    return rows.select("path", (F.col("__k") + F.col("__n")).alias("seg_id"), (F.col("frame_no") - F.coalesce("__l", "__last") - 1).alias("frame_no"), "features")
