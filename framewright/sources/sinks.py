"""Writers: text forms as columns of lines for Spark's own text sink, binary forms as one record a file, encoded and stored by the tasks."""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.order import places
from framewright.sources.files import archive_bytes
from framewright.sources.stores import opened, resolved

# ---------------------------------------------------------------- text


def number(x: Column) -> Column:
    """A double as text that reads back as the same double."""
    return x.cast("string")


def row_lines(frames: DataFrame, ids: bool = True, labels: bool = True) -> DataFrame:
    """line: `segment frame features label`, ids and label if asked for."""
    head = [F.col("seg_id").cast("string"), F.col("frame_no").cast("string")] if ids else []
    tail = [F.col("label").cast("string")] if labels else []
    values = F.array_join(F.transform("features", number), " ")
    return frames.select(F.concat_ws(" ", *head, values, *tail).alias("line"))


def sparse_lines(frames: DataFrame) -> DataFrame:
    """line: `segment frame place:value ...`, zeros left out."""
    cells = F.filter(F.transform("features", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: c["x"] != 0)
    return frames.select(F.concat_ws(" ", F.col("seg_id").cast("string"), F.col("frame_no").cast("string"), F.array_join(F.transform(cells, lambda c: F.concat(c["i"].cast("string"), F.lit(":"), number(c["x"]))), " ")).alias("line"))


def match_lines(matches: DataFrame, columns: list[str]) -> DataFrame:
    """pair, lines: the header `file1 file2` of each pair of files, and under it a line for each match, in order."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    per = matches.groupBy("f1", "f2").agg(F.array_sort(F.collect_list(F.struct(*columns, line.alias("__l")))).alias("m"))
    return per.select(F.concat_ws(" ", "f1", "f2").alias("pair"), F.transform("m", lambda x: x["__l"]).alias("lines"))


def numbered_match_lines(matches: DataFrame, columns: list[str]) -> DataFrame:
    """pair, at, line: the lines that `match_lines` has, numbered within their pair by ranges (`order.places`), so that no task holds all lines of a pair."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    rows = places(matches.select("f1", "f2", *columns), ["f1", "f2"], columns, "at")
    return rows.select(F.concat_ws(" ", "f1", "f2").alias("pair"), F.col("at").cast("int").alias("at"), line.alias("line"))


def class_lines(members: DataFrame) -> DataFrame:
    """cluster, lines: the members (file, start, end in frames) of each cluster as `file start end` in seconds, in order."""
    line = F.format_string("%s %.3f %.3f", F.col("file").cast("string"), F.col("start") / 100.0, F.col("end") / 100.0)
    per = members.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("file", "start", "end", line.alias("__l")))).alias("m"))
    return per.select("cluster", F.transform("m", lambda x: x["__l"]).alias("lines"))


def lattice_lines(arcs: DataFrame) -> DataFrame:
    """doc, lines: a word lattice of each document: its sizes, its nodes with their times, its arcs (start, end, word, score) in order.

    A document's lattice is one text; it holds as many lines as the document has arcs."""
    times = arcs.select("doc", F.explode(F.array("start", "end")).alias("t")).distinct()
    nodes = times.withColumn("node", F.dense_rank().over(Window.partitionBy("doc").orderBy("t")) - 1)
    ended = arcs.join(nodes.select("doc", F.col("t").alias("start"), F.col("node").alias("s")), ["doc", "start"]).join(nodes.select("doc", F.col("t").alias("end"), F.col("node").alias("e")), ["doc", "end"])
    drawn = ended.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "e", "word", "score"))).alias("a"))
    timed = nodes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("node", "t"))).alias("n"))
    each = drawn.join(timed, "doc")
    head = F.array(F.format_string("N=%d L=%d", F.size("n"), F.size("a")))
    points = F.transform("n", lambda x: F.format_string("I=%d t=%.2f", x["node"], x["t"] / 100.0))
    lines = F.transform("a", lambda x, i: F.format_string("J=%d S=%d E=%d W=%s a=%.4f", i, x["s"], x["e"], x["word"], x["score"]))
    return each.select("doc", F.concat(head, points, lines).alias("lines"))


def norm_lines(norms: DataFrame) -> DataFrame:
    """line: `feature mean deviation`."""
    return norms.select(F.concat_ws(" ", F.col("dim").cast("string"), number(F.col("mean")), number(F.col("sd"))).alias("line"))


def weight_lines(cells: DataFrame) -> DataFrame:
    """section, lines: the head `section size` and a line for each number, in the order of (row, column).  cells: (section, row, column, value); a model's sections are small."""
    per = cells.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("row", "column", "value"))).alias("c"))
    return per.select("section", F.concat(F.array(F.format_string("%s %d", "section", F.size("c"))), F.transform("c", lambda x: number(x["value"]))).alias("lines"))


# ---------------------------------------------------------------- runs of labels


def label_runs(frames: DataFrame) -> DataFrame:
    """seg_id, first, n, label: stretches of one label."""
    w = Window.partitionBy("seg_id").orderBy("frame_no")
    new = F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(1))
    rows = frames.select("seg_id", "frame_no", "label", new.alias("new")).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("seg_id", "run").agg(F.min("frame_no").alias("first"), F.count("*").alias("n"), F.first("label").alias("label")).drop("run")


def labels_of_runs(runs: DataFrame) -> DataFrame:
    """seg_id, frame_no, label: the runs frame by frame."""
    return runs.select("seg_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("frame_no"), "label")


# ---------------------------------------------------------------- binary


def encoded(frames: DataFrame, by: Column, encode: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """name, content: one file's bytes for each value of `by`, its frames in order.  A file is one record, so `by` bounds its size.

    Rows come sorted to the task that owns their file and pass through in batches; what is held is a batch and the file that it ends in."""
    columns = [c for c in frames.columns if c != "name"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            name = batch["name"].to_numpy()
            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
            names, contents = [], []
            for a, b in zip(cuts, cuts[1:]):
                if a or held and b and held[-1]["name"].iloc[0] != name[0]:  # a file has ended
                    names.append(held[-1]["name"].iloc[0])
                    contents.append(encode(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]))
                    held = []
                if b > a:
                    held.append(batch.iloc[a:b])
            if names:
                yield pd.DataFrame({"name": names, "content": contents})
        if held:
            yield pd.DataFrame({"name": [held[-1]["name"].iloc[0]], "content": [encode(pd.concat(held, ignore_index=True))]})

    rows = frames.select(*columns, by.cast("string").alias("name")).repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    return rows.sortWithinPartitions("name", "seg_id", "frame_no").mapInPandas(run, "name string, content binary")


def raw_bytes(dtype: str = "<f4") -> Callable[[pd.DataFrame], bytes]:
    return lambda g: np.stack(g["features"].to_numpy()).astype(dtype).tobytes()


def htk_bytes(period: int = 100_000, kind: int = 9) -> Callable[[pd.DataFrame], bytes]:
    def encode(g: pd.DataFrame) -> bytes:
        x = np.stack(g["features"].to_numpy()).astype(">f4")
        return struct.pack(">iihh", len(x), period, 4 * x.shape[1], kind) + x.tobytes()

    return encode


def flagged_bytes(dtype: str = "u1") -> Callable[[pd.DataFrame], bytes]:
    """Rows of a flag, 128 at the last frame of a segment, and the values."""

    def encode(g: pd.DataFrame) -> bytes:
        x = np.ascontiguousarray(np.stack(g["features"].to_numpy()).astype(dtype)).view(np.uint8).reshape(len(g), -1)
        seg = g["seg_id"].to_numpy()
        flag = np.append(seg[1:] != seg[:-1], True).astype(np.uint8) * 128
        return np.column_stack((flag, x)).tobytes()

    return encode


def archive_file(g: pd.DataFrame) -> bytes:
    """A segment archive; its segments are numbered from 0 in the file."""
    seg = pd.factorize(g["seg_id"], sort=True)[0]
    return archive_bytes(seg, g["frame_no"].to_numpy(), np.stack(g["features"].to_numpy()), g[["label"]].to_numpy())


def write_files(files: DataFrame, folder: str, suffix: str) -> None:
    """Stores (name, content) as files of a folder that all executors reach; each task writes under a name of its own first, so a task that runs twice does no harm.

    The folder may be any that Spark's file systems resolve: the driver makes it and asks where it really is."""
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    there = resolved(spark, folder)

    def store(rows: Iterator) -> None:
        import uuid

        system, top = opened(there)
        for r in rows:
            place, draft = posixpath.join(top, r["name"] + suffix), posixpath.join(top, f".{uuid.uuid4().hex}")
            with system.open_output_stream(draft) as out:
                out.write(bytes(r["content"]))
            system.move(draft, place)

    files.foreachPartition(store)
