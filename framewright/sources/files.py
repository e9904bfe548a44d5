"""Readers of matrix, archive, feature and sound files as frames; each file is one binary record, decoded with numpy in its task.

Paths go through Spark, so any store that Spark reads will do.  Columns: path, frame_no, features (and seg_id, labels for archives)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.codecs import mulaw_samples
from framewright.operators.order import places, sums_before

ROWS = 10_000
HEADER = 32_768  # bytes of an archive's text header
FRAMES = "path string, frame_no long, features array<double>"


def _decoded(spark: SparkSession, path: str | list[str], decode, schema: str = FRAMES) -> DataFrame:
    """decode(bytes) gives a dict of columns; frames come out in batches."""
    names = [x.split()[0] for x in schema.split(", ")][1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                columns = decode(content)
                n = len(columns[names[0]])
                for i in range(0, n, ROWS):
                    part = {k: list(v[i : i + ROWS]) if getattr(v, "ndim", 1) > 1 else v[i : i + ROWS] for k, v in columns.items()}
                    yield pd.DataFrame({"path": where} | part)[["path", *names]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def raw_matrix(spark: SparkSession, path, width: int, dtype: str = "<f4", skip: int = 0, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows of `width` numbers after `skip` bytes, or rows first..last of them, which keep their numbers; an error if the bytes don't divide."""

    def decode(content: bytes) -> dict:
        x = np.frombuffer(content, dtype, offset=skip)
        if len(x) % width:
            raise ValueError(f"{len(x)} numbers aren't rows of {width}")
        x = x.reshape(-1, width)[first : None if last is None else last + 1].astype(np.float64)
        return {"frame_no": np.arange(first, first + len(x)), "features": x}

    return _decoded(spark, path, decode)


def signatures(spark: SparkSession, path, first: int = 0, last: int | None = None) -> DataFrame:
    """64-bit signatures first..last of each file: path, frame_no, sig."""

    def decode(content: bytes) -> dict:
        x = np.frombuffer(content, "<i8")[first : None if last is None else last + 1]
        return {"frame_no": np.arange(first, first + len(x)), "sig": x}

    return _decoded(spark, path, decode, "path string, frame_no long, sig long")


def sized_matrix(spark: SparkSession, path) -> DataFrame:
    """A 32-bit width, then rows of 32-bit floats."""

    def decode(content: bytes) -> dict:
        x = np.frombuffer(content, "<f4", offset=4).reshape(-1, struct.unpack_from("<i", content)[0]).astype(np.float64)
        return {"frame_no": np.arange(len(x)), "features": x}

    return _decoded(spark, path, decode)


def htk(spark: SparkSession, path) -> DataFrame:
    """A 12-byte big-endian header (frames, period, bytes of a frame, kind), then 32-bit floats."""

    def decode(content: bytes) -> dict:
        n, _, size, _ = struct.unpack_from(">iihh", content)
        x = np.frombuffer(content, ">f4", offset=12, count=n * size // 4).reshape(n, size // 4).astype(np.float64)
        return {"frame_no": np.arange(n), "features": x}

    return _decoded(spark, path, decode)


def archive_fields(content: bytes) -> dict[str, int]:
    text = content[:HEADER].split(b"\0")[0].decode("ascii")
    return {k: int(v) for k, v in re.findall(r"^-(num_\w+|first_\w+)\s+(\d+)", text, re.M)}


def archive(spark: SparkSession, path) -> DataFrame:
    """Segment archives: a text header, then big-endian rows [segment, frame, features, labels]."""

    def decode(content: bytes) -> dict:
        f = archive_fields(content)
        columns = 2 + f["num_features"] + f["num_labels"]
        cells = np.frombuffer(content, ">u4", offset=HEADER, count=f["num_frames"] * columns).reshape(-1, columns)
        a, b = f.get("first_feature_column", 2), f.get("first_label_column", 2 + f["num_features"])
        features = np.ascontiguousarray(cells[:, a : a + f["num_features"]]).view(">f4").astype(np.float64)
        return {"seg_id": cells[:, 0].astype(np.int64), "frame_no": cells[:, 1].astype(np.int64), "features": features, "labels": cells[:, b : b + f["num_labels"]].astype(np.int64)}

    return _decoded(spark, path, decode, "path string, seg_id long, frame_no long, features array<double>, labels array<long>")


def archive_bytes(seg: np.ndarray, frame: np.ndarray, features: np.ndarray, labels: np.ndarray) -> bytes:
    """One archive file of frames in order, with its index of segment starts."""
    n, f, k = len(seg), features.shape[1], labels.shape[1]
    starts = np.concatenate((np.flatnonzero(np.diff(seg, prepend=-1)), [n])) if n else np.array([0])
    ncol = 2 + f + k
    text = (
        f"-pfile_header version 0 size {HEADER}\n-num_sentences {len(starts) - 1}\n-num_frames {n}\n-first_feature_column 2\n-num_features {f}\n-first_label_column {2 + f}\n-num_labels {k}\n"
        f"-format 2d{f}f{k}d\n-data size {n * ncol} offset 0 ndim 2 nrow {n} ncol {ncol}\n-sent_table_data size {len(starts)} offset {n * ncol} ndim 1\n-end\n"
    )
    cells = np.empty((n, ncol), ">u4")
    cells[:, 0], cells[:, 1], cells[:, 2 + f :] = seg, frame, labels
    cells[:, 2 : 2 + f] = np.ascontiguousarray(features.astype(">f4")).view(">u4")
    return text.encode().ljust(HEADER, b"\0") + cells.tobytes() + starts.astype(">u4").tobytes()


def wav(spark: SparkSession, path) -> DataFrame:
    """PCM sound: path, rate, sample_no, channels (8-bit unsigned or 16-bit samples as numbers)."""

    def decode(content: bytes) -> dict:
        at, fmt = 12, None
        while at + 8 <= len(content):
            name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
            if name == b"fmt ":
                fmt = struct.unpack_from("<HHIIHH", content, at + 8)
            elif name == b"data":
                x = np.frombuffer(content, np.uint8 if fmt[5] == 8 else "<i2", offset=at + 8, count=size // (fmt[5] // 8)).astype(np.float64)
                x = (x - 128 if fmt[5] == 8 else x).reshape(-1, fmt[1])
                return {"rate": np.full(len(x), fmt[2]), "sample_no": np.arange(len(x)), "channels": x}
            at += 8 + size + size % 2
        raise ValueError("no data chunk")

    return _decoded(spark, path, decode, "path string, rate long, sample_no long, channels array<double>")


def timed_text(spark: SparkSession, path) -> DataFrame:
    """Lines `time v1 ... vN`: file, time, features."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), parts.alias("p"))
    return rows.select("file", F.get("p", 0).cast("double").alias("time"), F.slice("p", 2, 2**30).cast("array<double>").alias("features"))


def matches_text(spark: SparkSession, path) -> DataFrame:
    """Match lists: a line `file1 file2` heads the rows `xa xb ya yb score rho` under it."""
    rows = spark.read.text(path, wholetext=True)
    blocks = rows.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\S+ \S+$(?:\n(?!\S+ \S+$)\S.*)*"), F.lit(0))).alias("b"))
    lines = blocks.select(F.split("b", "\n").alias("l")).select(F.split(F.get("l", 0), " ").alias("h"), F.explode(F.slice("l", 2, 2**30)).alias("row"))
    p = F.split("row", " ")
    return lines.select(F.get("h", 0).alias("f1"), F.get("h", 1).alias("f2"), *[F.get(p, i).cast("int").alias(n) for i, n in enumerate(("xa", "xb", "ya", "yb"))], F.get(p, 4).cast("double").alias("score"), F.get(p, 5).cast("double").alias("rho"))


# ---------------------------------------------------------------- text forms


def row_text(spark: SparkSession, path, labels: bool = True) -> DataFrame:
    """Lines `segment frame features label`: seg_id, frame_no, features, label (a token, as it stands)."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p"))
    width = F.size("p") - (3 if labels else 2)
    return rows.select(F.get("p", 0).cast("long").alias("seg_id"), F.get("p", 1).cast("long").alias("frame_no"), F.slice("p", 3, width).cast("array<double>").alias("features"), *([F.element_at("p", -1).alias("label")] if labels else []))


def mapped_tokens(frames: DataFrame, tokens: DataFrame) -> DataFrame:
    """Labels by a token map (token, label); a token that it lacks is an error."""
    rows = frames.withColumnRenamed("label", "token").join(tokens, "token", "left")
    known = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label for "), F.col("token"))).cast("int")).otherwise(F.col("label"))
    return rows.withColumn("label", known).drop("token")


def sparse_text(spark: SparkSession, path, width: int) -> DataFrame:
    """Lines `segment frame place:value ...`: seg_id, frame_no, cells (a map) and features (filled up with zeros)."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p"))
    cells = F.map_from_entries(F.transform(F.filter(F.slice("p", 3, 2**30), lambda c: c != ""), lambda c: F.struct(F.split(c, ":")[0].cast("int"), F.split(c, ":")[1].cast("double"))))
    rows = rows.select(F.get("p", 0).cast("long").alias("seg_id"), F.get("p", 1).cast("long").alias("frame_no"), cells.alias("cells"))
    return rows.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("cells", i), F.lit(0.0))))


def text_matrix(spark: SparkSession, path) -> DataFrame:
    """Lines of numbers, a file for each segment: path, frame_no, features."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.rtrim("value"), "\n")).alias("frame_no", "line"))
    return rows.where(F.trim("line") != "").select("path", F.col("frame_no").cast("long").alias("frame_no"), F.split(F.trim("line"), r"\s+").cast("array<double>").alias("features"))


def tokens_text(spark: SparkSession, path) -> DataFrame:
    """The tokens of each file in order: path, place, token."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("place", "token"))
    return rows.where("token <> ''")


def norms_text(spark: SparkSession, path) -> DataFrame:
    """Lines `feature mean deviation`."""
    p = F.split("value", " ")
    return spark.read.text(path).select(F.get(p, 0).cast("int").alias("dim"), F.get(p, 1).cast("double").alias("mean"), F.get(p, 2).cast("double").alias("sd"))


def weights_text(spark: SparkSession, path, widths: dict[str, int]) -> DataFrame:
    """Weight files of sections, each a line `section size` and its numbers by rows of the section's width: path, section, row, column, value.  A size that isn't the number of numbers is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^[A-Za-z]\w*\s+\d+$(?:\n(?![A-Za-z])[^\n]*)*"), F.lit(0))).alias("part"))
    parts = rows.select("path", F.split(F.btrim("part", F.lit(" \t\r\n")), r"\s+").alias("p")).select("path", F.get("p", 0).alias("section"), F.get("p", 1).cast("long").alias("size"), F.slice("p", 3, 2**30).alias("v"))
    whole = F.when(F.size("v") == F.col("size"), F.col("v")).otherwise(F.raise_error(F.concat(F.col("section"), F.lit(": its size isn't that of its numbers"))))
    width = F.coalesce(*[F.when(F.col("section") == k, n) for k, n in widths.items()], F.lit(1))
    cells = parts.select("path", "section", width.alias("width"), F.posexplode(whole).alias("at", "value"))
    return cells.select("path", "section", F.floor(F.col("at") / F.col("width")).alias("row"), (F.col("at") % F.col("width")).cast("long").alias("column"), F.col("value").cast("double").alias("value"))


def au(spark: SparkSession, path) -> DataFrame:
    """Sound with a `.snd` header: path, rate, sample_no, channels (mu-law, 8- or 16-bit samples as numbers)."""

    def decode(content: bytes) -> dict:
        magic, offset, size, coding, rate, channels = struct.unpack_from(">4sIIIII", content)
        if magic != b".snd" or coding not in (1, 2, 3):
            raise ValueError("no .snd header of a known coding")
        data = content[offset:] if size == 0xFFFFFFFF else content[offset : offset + size]
        x = {1: lambda: mulaw_samples(np.frombuffer(data, np.uint8)), 2: lambda: np.frombuffer(data, np.int8), 3: lambda: np.frombuffer(data, ">i2", count=len(data) // 2)}[coding]().astype(np.float64)
        x = x[: len(x) // channels * channels].reshape(-1, channels)
        return {"rate": np.full(len(x), rate), "sample_no": np.arange(len(x)), "channels": x}

    return _decoded(spark, path, decode, "path string, rate long, sample_no long, channels array<double>")


# ---------------------------------------------------------------- many files


def listed(spark: SparkSession, list_file: str) -> list[str]:
    """The paths that a list file names, one a line; for any reader that takes paths."""
    return [r["value"].strip() for r in spark.read.text(list_file).where(F.trim("value") != "").collect()]  # a list of files to read is the reader's argument


def logical(frames: DataFrame) -> DataFrame:
    """Archives of several files as one: segments numbered on from file to file, in the order of their paths."""
    sizes = frames.groupBy("path").agg((F.max("seg_id") + 1).alias("n"))  # a row for each file
    starts = sums_before(sizes, [], ["path"], "n", "__start").drop("n")
    return frames.join(starts, "path").withColumn("seg_id", F.col("seg_id") + F.col("__start")).drop("__start")


def built(matrices: DataFrame, labels: DataFrame) -> DataFrame:
    """An archive of raw matrices (path, frame_no, features), a segment each in the order of their paths, and labels (row_no, label) by row over all."""
    sizes = matrices.groupBy("path").agg(F.count("*").alias("n"))  # a row for each file
    starts = places(sums_before(sizes, [], ["path"], "n", "__start"), [], ["path"], "seg_id").drop("n")
    rows = matrices.join(starts, "path").withColumn("row_no", F.col("frame_no") + F.col("__start"))
    return rows.join(labels, "row_no").select("seg_id", "frame_no", "features", "label")


READERS = {"raw": raw_matrix, "sized": sized_matrix, "htk": htk, "archive": archive, "rows": row_text, "sparse": sparse_text, "text": text_matrix, "timed": timed_text, "tokens": tokens_text, "wav": wav, "au": au, "matches": matches_text, "signatures": signatures, "norms": norms_text, "weights": weights_text}


def read(spark: SparkSession, kind: str, path, **options) -> DataFrame:
    """Any of the formats by name."""
    if kind not in READERS:
        raise ValueError(f"no format {kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)
