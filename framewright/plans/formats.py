"""Queries that write a format to the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import arrays
from framewright.operators import stats
from framewright.operators.graph import shared_folder
from framewright.plans.catalogue import FRAMES, LONG, NODES, ROW, VECTORS, flat, interval_nodes, query
from framewright.plans.reports import MATCHES, found_matches
from framewright.sources import files, ranged, sinks
from framewright.sources.frames import lineitem_frames, table, vectors


def folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def through_text(lines: DataFrame, kind: str) -> str:
    """Writes a column of lines by Spark's text sink; where they are."""
    path = folder(lines.sparkSession, kind)
    lines.write.text(path)
    return path


def user_frames(spark, sf_dir) -> DataFrame:
    """A user's values as a segment of two features."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seg_id"), (F.row_number().over(w) - 1).alias("frame_no"), F.array("value", F.col("event_id").cast("double") % 1000).alias("features"), (F.col("event_id") % 3).cast("int").alias("label"))


USERS = "us AS (SELECT user_id AS seg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS f0, CAST(event_id % 1000 AS DOUBLE) AS f1, CAST(event_id % 3 AS INTEGER) AS label FROM events)"


def two(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("seg_id").cast("long").alias("seg_id"), F.col("frame_no").cast("long").alias("frame_no"), *more, F.round(F.get("features", 0), 3).alias("f0"), F.get("features", 1).alias("f1"))


def with_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("seg_id", F.regexp_extract("path", r"(-?\d+)\.\w+$", 1).cast("long"))


def with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long"))


@query(f"WITH {FRAMES} SELECT seg_id, frame_no, label, {ROW} FROM f")
def format_rows(spark, sf_dir):
    """Text rows with ids, written and read; labels through a token map."""
    f = lineitem_frames(spark, sf_dir).withColumn("label", F.concat(F.lit("class"), "label"))
    tokens = spark.createDataFrame([(f"class{i}", i) for i in range(3)], "token string, label int")
    return flat(files.mapped_tokens(files.row_text(spark, through_text(sinks.row_lines(f), "rows")), tokens), 4, "label")


@query("WITH f AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS frame_no, l_discount, l_tax FROM lineitem) SELECT l_orderkey AS seg_id, frame_no, round(l_discount, 6) AS f0, round(l_tax, 6) AS f1, CAST((CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END) + (CASE WHEN l_tax <> 0 THEN 1 ELSE 0 END) AS INTEGER) AS cells FROM f")
def format_sparse(spark, sf_dir):
    f = lineitem_frames(spark, sf_dir).withColumn("features", F.slice("features", 3, 2))
    back = files.sparse_text(spark, through_text(sinks.sparse_lines(f), "sparse"), 2)
    return flat(back.withColumn("cells", F.size("cells")), 2, "cells")


@query(f"WITH {FRAMES}, r AS (SELECT *, frame_no - row_number() OVER (PARTITION BY seg_id, label ORDER BY frame_no) AS g FROM f) SELECT seg_id, min(frame_no) AS \"first\", count(*) AS n, label FROM r GROUP BY seg_id, label, g")
def format_label_runs(spark, sf_dir):
    """Labels as runs."""
    return sinks.label_runs(lineitem_frames(spark, sf_dir))


@query(f"WITH {FRAMES} SELECT seg_id, frame_no, label FROM f")
def format_labels_of_runs(spark, sf_dir):
    """Labels as runs, and frame by frame again."""
    return sinks.labels_of_runs(sinks.label_runs(lineitem_frames(spark, sf_dir)))


@query(f"WITH {USERS} SELECT seg_id, frame_no, f0, f1 FROM us")
def format_htk(spark, sf_dir):
    """One file a segment, written by the tasks and read."""
    path = folder(spark, "htk")
    sinks.write_files(sinks.encoded(user_frames(spark, sf_dir), F.col("seg_id"), sinks.htk_bytes()), path, ".htk")
    return two(with_segment(files.read(spark, "htk", f"{path}/*.htk")))


@query(f"WITH {USERS} SELECT seg_id, frame_no, f0, f1 FROM us WHERE frame_no BETWEEN 2 AND 7")
def format_raw_slice(spark, sf_dir):
    """Raw big-endian matrices, of which frames 2 to 7 are read."""
    path = folder(spark, "raw")
    sinks.write_files(sinks.encoded(user_frames(spark, sf_dir), F.col("seg_id"), sinks.raw_bytes(">f4")), path, ".raw")
    return two(with_segment(files.read(spark, "raw", f"{path}/*.raw", width=2, dtype=">f4", first=2, last=7)))


#: Frames of an archive file; the number of files follows from the number of frames.
FILE_FRAMES = 2_000
FILED = f"{USERS}, fl AS (SELECT *, printf('%06d', abs(seg_id) % (SELECT greatest(1, (count(*) + {FILE_FRAMES - 1}) // {FILE_FRAMES}) FROM us)) AS file FROM us)"


def archived(spark, sf_dir) -> str:
    """Users' frames as segment archives, written by the tasks; where they are."""
    path, f = folder(spark, "archive"), user_frames(spark, sf_dir)
    n = max(1, -(-f.count() // FILE_FRAMES))
    sinks.write_files(sinks.encoded(f, F.format_string("%06d", F.abs("seg_id") % n), sinks.archive_file), path, ".pfile")
    return path


@query(f"WITH {FILED}, k AS (SELECT DISTINCT seg_id, file FROM fl), m AS (SELECT seg_id, row_number() OVER (ORDER BY file, seg_id) - 1 AS number FROM k) SELECT number AS seg_id, frame_no, label, f0, f1 FROM us JOIN m USING (seg_id)")
def format_archives(spark, sf_dir):
    """Segment archives, as many as the frames ask for, written by the tasks, read as one with segments numbered through."""
    back = files.logical(files.read(spark, "archive", f"{archived(spark, sf_dir)}/*.pfile"))
    return two(back.withColumn("label", F.get("labels", 0).cast("int")), "label")


@query(f"WITH {FILED} SELECT CAST(file AS BIGINT) AS file, dense_rank() OVER (PARTITION BY file ORDER BY seg_id) - 1 AS seg_id, frame_no, label, f0, f1 FROM fl")
def scan_archive_ranges(spark, sf_dir):
    """Segment archives read in ranges of segments: several partitions of one file."""
    back = ranged.scan(spark, "archive", f"{archived(spark, sf_dir)}/*.pfile", part_bytes=16_384)
    return two(with_file(back).withColumn("label", F.get("labels", 0).cast("int")), "file", "label")


@query(f"WITH {FILED}, r AS (SELECT CAST(file AS BIGINT) AS file, dense_rank() OVER (PARTITION BY file ORDER BY seg_id) - 1 AS seg_id, frame_no, label, f0, f1 FROM fl), n AS (SELECT file, max(seg_id) AS last FROM r GROUP BY file) SELECT r.* FROM r JOIN n USING (file) WHERE seg_id >= 2 AND seg_id <> last - 1 AND frame_no BETWEEN 3 AND 9")
def scan_archive_slice(spark, sf_dir):
    """All segments from the third on but the last but one, and frames 3 to 9 of each: only their bytes are read."""
    back = ranged.scan(spark, "archive", f"{archived(spark, sf_dir)}/*.pfile", part_bytes=16_384, segments="all/^1").where("seg_id >= 2 AND frame_no BETWEEN 3 AND 9")
    return two(with_file(back).withColumn("label", F.get("labels", 0).cast("int")), "file", "label")


@query(f"WITH {USERS} SELECT seg_id, frame_no, f0, f1 FROM us WHERE frame_no BETWEEN 2 AND 7")
def scan_raw_ranges(spark, sf_dir):
    """Raw big-endian matrices read in ranges of rows, of which frames 2 to 7 are asked."""
    path = folder(spark, "raw")
    sinks.write_files(sinks.encoded(user_frames(spark, sf_dir), F.col("seg_id"), sinks.raw_bytes(">f4")), path, ".raw")
    return two(with_segment(ranged.scan(spark, "raw", f"{path}/*.raw", width=2, dtype=">f4", part_bytes=32)).where("frame_no BETWEEN 2 AND 7"))


@query(f"WITH {USERS}, s AS (SELECT DISTINCT seg_id, lpad(CAST(seg_id AS VARCHAR), 12, '0') AS name FROM us), o AS (SELECT us.*, row_number() OVER (ORDER BY name, frame_no) - 1 AS row_no, dense_rank() OVER (ORDER BY name) - 1 AS number FROM us JOIN s USING (seg_id)) SELECT number AS seg_id, frame_no, CAST(row_no % 5 AS INTEGER) AS label, f0, f1 FROM o")
def format_archive_built(spark, sf_dir):
    """An archive of raw matrices and a list of labels for all their rows."""
    path = folder(spark, "built")
    f = user_frames(spark, sf_dir)
    sinks.write_files(sinks.encoded(f, F.lpad(F.col("seg_id").cast("string"), 12, "0"), sinks.raw_bytes()), path, ".raw")
    matrices = files.read(spark, "raw", f"{path}/*.raw", width=2)
    labels = spark.range(f.count()).select(F.col("id").alias("row_no"), (F.col("id") % 5).cast("int").alias("label"))
    return two(files.built(matrices, labels), "label")


@query(f"WITH {LONG} SELECT CAST(dim AS INTEGER) AS dim, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd FROM e GROUP BY dim")
def format_norms(spark, sf_dir):
    back = files.norms_text(spark, through_text(sinks.norm_lines(stats.norms(lineitem_frames(spark, sf_dir))), "norms"))
    return back.select("dim", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query(f"WITH {NODES}, m AS (SELECT file % 40 AS cluster, file, \"start\" AS s, \"end\" AS e FROM nd), l AS (SELECT cluster, list(printf('%s %.3f %.3f', CAST(file AS VARCHAR), s / 100.0, e / 100.0) ORDER BY file, s, e) AS lines FROM m GROUP BY cluster) SELECT cluster, unnest(range(len(lines))) AS at, unnest(lines) AS line FROM l")
def format_class_lines(spark, sf_dir):
    nodes = interval_nodes(spark, sf_dir).withColumn("cluster", F.col("file") % 40)
    return sinks.class_lines(nodes).select("cluster", F.posexplode("lines").alias("at", "line"))


ARCS = "ar AS (SELECT o_custkey AS doc, epoch(o_orderdate) // 86400 AS s, epoch(o_orderdate) // 86400 + 10 + o_orderkey % 20 AS e, 'w' || (o_orderkey % 97) AS word, (o_orderkey % 1000) / 1000.0 AS score FROM orders)"


@query(f"WITH {ARCS}, tm AS (SELECT DISTINCT doc, unnest([s, e]) AS t FROM ar), nn AS (SELECT doc, t, dense_rank() OVER (PARTITION BY doc ORDER BY t) - 1 AS node FROM tm), dr AS (SELECT ar.doc, a.node AS s, b.node AS e, word, score, row_number() OVER (PARTITION BY ar.doc ORDER BY a.node, b.node, word, score) - 1 AS j FROM ar JOIN nn a ON a.doc = ar.doc AND a.t = ar.s JOIN nn b ON b.doc = ar.doc AND b.t = ar.e), "
       "sz AS (SELECT doc, count(*) AS n FROM nn GROUP BY doc), al AS (SELECT doc, count(*) AS l FROM dr GROUP BY doc) SELECT doc, 0 AS at, printf('N=%d L=%d', n, l) AS line FROM sz JOIN al USING (doc) UNION ALL SELECT doc, 1 + node, printf('I=%d t=%.2f', node, t / 100.0) FROM nn UNION ALL SELECT doc, 1 + n + j, printf('J=%d S=%d E=%d W=%s a=%.4f', j, s, e, word, score) FROM dr JOIN sz USING (doc)")  # fmt: skip
def format_lattices(spark, sf_dir):
    """A word lattice of each customer's orders."""
    start = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    arcs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), start.alias("start"), (start + 10 + F.col("o_orderkey") % 20).alias("end"), F.concat(F.lit("w"), F.col("o_orderkey") % 97).alias("word"), ((F.col("o_orderkey") % 1000) / 1000.0).alias("score"))
    return sinks.lattice_lines(arcs).select("doc", F.posexplode("lines").alias("at", "line"))


@query("SELECT conv_id, unnest(range(len(t))) AS place, unnest(t) AS token FROM (SELECT conv_id, string_split(string_agg(role, ' ' ORDER BY turn, text), ' ') AS t FROM conversations GROUP BY conv_id)")
def format_tokens(spark, sf_dir):
    """Token files, one for each conversation."""
    path = folder(spark, "tokens")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("r"))
    lines = rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), " ").alias("line"))
    lines.select(F.col("conv_id").cast("string").alias("name"), F.encode("line", "UTF-8").alias("content")).transform(lambda d: sinks.write_files(d, path, ".txt") or d)
    back = files.read(spark, "tokens", f"{path}/*.txt")
    return back.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("conv_id"), "place", "token")


CODED = f"{VECTORS}, pb AS (SELECT vec_id, list_transform(features, lambda v: exp(v - list_max(features))) AS e FROM v), cd AS (SELECT vec_id, list_transform(e, lambda v: least(greatest(floor(-24 * ln(v / list_sum(e) + 1e-37)), 0), 255)) AS c FROM pb), sg AS (SELECT vec_id % 50 AS seg, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) - 1 AS frame_no, c FROM cd)"


@query(f"WITH {CODED}, fl AS (SELECT seg % 3 AS file, seg // 3 AS seg_id, frame_no, c FROM sg) SELECT file, seg_id, frame_no, i::INTEGER AS i, c[i + 1]::INTEGER AS code FROM fl, range(64) r(i)")
def format_flagged_codes(spark, sf_dir):
    """Probabilities as 8-bit codes behind an end-of-segment flag, written by the tasks, read in ranges; segments follow from the flags."""
    w = Window.partitionBy("seg").orderBy("vec_id")
    own = vectors(spark, sf_dir).withColumn("seg", F.col("vec_id") % 50).withColumn("frame_no", (F.row_number().over(w) - 1).cast("long"))
    coded = own.select(F.floor(F.col("seg") / 3).alias("seg_id"), "frame_no", arrays.lna8(arrays.softmax(F.col("features"))).alias("features"), (F.col("seg") % 3).alias("file"))
    path = folder(spark, "codes")
    sinks.write_files(sinks.encoded(coded, F.col("file"), sinks.flagged_bytes()), path, ".codes")
    back = ranged.segmented(ranged.scan(spark, "flagged", f"{path}/*.codes", width=64, part_bytes=1_000), 8)
    return with_file(back).select("file", "seg_id", "frame_no", F.posexplode("features").alias("i", "code")).withColumn("code", F.col("code").cast("int"))


@query(f"WITH {VECTORS}, m AS (SELECT label, i, round(avg(features[i + 1]), 6) AS value FROM v, range(64) r(i) GROUP BY label, i), b AS (SELECT label, round(-sum(value * value) / 2, 5) AS value FROM m GROUP BY label) SELECT 'weigvec' AS section, dense_rank() OVER (ORDER BY label) - 1 AS row, i AS column, value FROM m UNION ALL SELECT 'biasvec', row_number() OVER (ORDER BY label) - 1, 0, value FROM b".replace(" AS row,", ' AS "row",').replace(" AS column,", ' AS "column",'))
def format_weights(spark, sf_dir):
    """A layer that compares a vector with the means of the labels, as a weight file, written and read."""
    long = vectors(spark, sf_dir).select("label", F.posexplode("features").alias("column", "v"))
    means = long.groupBy("label", "column").agg(F.round(F.avg("v"), 6).alias("value"))
    bias = means.groupBy("label").agg(F.round(-F.sum(F.col("value") * F.col("value")) / 2, 5).alias("value"))
    rows = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1  # a row for each label
    cells = means.select(F.lit("weigvec").alias("section"), rows.cast("long").alias("row"), F.col("column").cast("long").alias("column"), "value")
    cells = cells.union(bias.select(F.lit("biasvec"), rows.cast("long"), F.lit(0).cast("long"), "value"))
    lines = sinks.weight_lines(cells).coalesce(1).select(F.explode("lines").alias("line"))
    return files.weights_text(spark, through_text(lines, "weights"), {"weigvec": 64}).drop("path")


@query(f"WITH {MATCHES}, l AS (SELECT file, list(xa || ' ' || xb || ' ' || ya || ' ' || yb ORDER BY xa, xb, ya, yb) AS lines FROM mt GROUP BY file) SELECT 'f' || file || ' f' || file AS pair, unnest(range(len(lines)))::INTEGER AS at, unnest(lines) AS line FROM l")
def format_match_lines(spark, sf_dir):
    """Match lists: a header for each pair of files, a line for each match."""
    own = found_matches(spark, sf_dir).withColumn("f1", F.concat(F.lit("f"), F.col("file").cast("string"))).withColumn("f2", F.col("f1"))
    return sinks.numbered_match_lines(own, ["xa", "xb", "ya", "yb"])
