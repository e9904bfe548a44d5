"""Queries of selection, archive arithmetic, normalisation, vector algebra and windows."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import arrays, ranges
from framewright.operators import archive, stats, windows
from framewright.plans.catalogue import BRIDGED, FRAMES, ISLANDS, LONG, POST, ROW, SOFT, TEN, VECTORS, filter_sql, filtered, flat, listed, listed_sql, query, speech, ten
from framewright.sources.frames import lineitem_frames, posteriors, table, vectors

# ---------------------------------------------------------------- selection


@query(f"WITH {FRAMES} SELECT seg_id - 100 AS seg_id, frame_no, {ROW} FROM f WHERE seg_id BETWEEN 100 AND 400")
def archive_contiguous(spark, sf_dir):
    return flat(archive.contiguous(lineitem_frames(spark, sf_dir), 100, 400))


NAMED = "pl AS (SELECT 0 AS item, unnest(range(0, 91)) AS k, 100 - unnest(range(0, 91)) AS seg UNION ALL SELECT 1, 0, 55 UNION ALL SELECT 2, unnest(range(0, 300)), unnest(range(0, 300)) * 7)"


@query(f"WITH {FRAMES}, {NAMED} SELECT item, k, seg_id, frame_no, {ROW} FROM pl JOIN f ON f.seg_id = pl.seg AND NOT (item > 0 AND seg % 10 = 0) AND NOT (item < 2 AND seg BETWEEN 50 AND 53)")
def archive_segments_in_order(spark, sf_dir):
    """100 down to 10 but 50-53; 55; every seventh but the tens."""
    rows = archive.segments_in_order(lineitem_frames(spark, sf_dir), "100-10/50-53;55;0:7:2093/0:10:3000", 3001)
    return flat(rows.select("*", F.col("place.item").alias("item"), F.col("place.k").alias("k")), 4, "item", "k")


@query(f"WITH {FRAMES}, x AS (SELECT f.*, n, unnest([0, 1, 2]) AS item FROM f JOIN n USING (seg_id)), y AS (SELECT *, CASE item WHEN 0 THEN n - 1 - frame_no ELSE 0 END AS k FROM x WHERE item = 0 OR (item = 1 AND frame_no = 0) OR (item = 2 AND frame_no = n - 1)) SELECT seg_id, row_number() OVER (PARTITION BY seg_id ORDER BY item, k) - 1 AS frame_no, {ROW} FROM y")
def archive_frames_in_order(spark, sf_dir):
    """Each segment backwards, then its first and its last frame again."""
    return flat(archive.frames_in_order(lineitem_frames(spark, sf_dir), "^0-0;0,^0"))


@query(f"WITH {FRAMES} SELECT seg_id, frame_no, CAST(CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS INTEGER) AS a, label AS b FROM f")
def archive_label_project(spark, sf_dir):
    rows = lineitem_frames(spark, sf_dir).withColumn("labels", F.array("label", F.when(F.col("l_linestatus") == "F", 1).otherwise(0)))
    return archive.project(rows, [1, 0], "labels").select("seg_id", "frame_no", F.get("labels", 0).alias("a"), F.get("labels", 1).alias("b"))


@query(f"WITH {FRAMES} SELECT CASE WHEN seg_id % 10 = 3 THEN 'held' ELSE 'train' END AS part, count(*) AS frames, count(DISTINCT seg_id) AS segments FROM f GROUP BY 1")
def archive_split(spark, sf_dir):
    """Every tenth segment from 3 on is held out."""
    held, train = archive.split(lineitem_frames(spark, sf_dir), "3:10:99999999", 10**8)
    rows = held.select(F.lit("held").alias("part"), "seg_id").unionByName(train.select(F.lit("train").alias("part"), "seg_id"))
    return rows.groupBy("part").agg(F.count("*").alias("frames"), F.countDistinct("seg_id").alias("segments"))


@query(f"WITH {FRAMES} SELECT seg_id, frame_no, label, {ROW} FROM f")
def archive_with_labels(spark, sf_dir):
    """Features and labels taken apart, and put together again."""
    features, labels = archive.columns_apart(lineitem_frames(spark, sf_dir))
    return flat(archive.with_labels(features, labels), 4, "label")


@query(f"WITH {FRAMES} SELECT seg_id, frame_no, label FROM f WHERE label < 2")
def archive_accepted(spark, sf_dir):
    return archive.accepted(lineitem_frames(spark, sf_dir), 2).select("seg_id", "frame_no", "label")


@query(f"WITH {FRAMES}, g AS (SELECT seg_id, frame_no, unnest([0, 1, 2, 3]) AS col, unnest(features) AS a, l_linestatus FROM f), h AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN a * 1.01 ELSE a END AS b FROM g) SELECT seg_id, frame_no, CAST(col AS INTEGER) AS col, round(a, 6) AS a, round(b, 6) AS b FROM h WHERE abs(a - b) > 0.5 ORDER BY seg_id, frame_no, col LIMIT 1")
def archive_diff_first(spark, sf_dir):
    """The first place where two archives differ."""
    f = lineitem_frames(spark, sf_dir)
    g = f.withColumn("features", F.transform("features", lambda x: F.when(F.col("l_linestatus") == "F", x * 1.01).otherwise(x)))
    return archive.diff(f, g, 0.5, first=True).select("seg_id", "frame_no", "col", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


FOUR = ", ".join(f"round((0.002 * features[{i}] + 0.0005 * features[{5 - i}]) * (0.003 * features[{i}]) - features[{5 - i}] + 7.0003, 2) + 0.0 AS f{i - 1}" for i in range(1, 5))


@query(f"WITH {FRAMES} SELECT seg_id, frame_no, {FOUR} FROM f")
def archive_arithmetic(spark, sf_dir):
    """(0.002 a + 0.0005 b) * 0.003 a - b + 7.0003, over four archives from left to right."""
    f = lineitem_frames(spark, sf_dir)
    g = archive.project(f, [3, 2, 1, 0])
    rows = archive.arithmetic([f, g, f, g], [0.002, 0.0005, 0.003, 1.0], ["add", "mul", "sub"], 7.0003)
    return rows.select("seg_id", "frame_no", *[(F.round(F.get("features", i), 2) + 0.0).alias(f"f{i}") for i in range(4)])


@query(f"WITH {FRAMES} SELECT seg_id, frame_no // 2 AS frame_no, {ROW} FROM f WHERE frame_no % 2 = 0")
def archive_downsample(spark, sf_dir):
    return flat(archive.downsample(lineitem_frames(spark, sf_dir), 2))


@query(f"WITH {FRAMES}, t AS (SELECT seg_id, list(features[1] ORDER BY frame_no) AS v FROM f GROUP BY seg_id) SELECT seg_id, unnest(range(len(v))) AS at, unnest(v) AS value FROM t")
def archive_trajectory(spark, sf_dir):
    return archive.trajectory(lineitem_frames(spark, sf_dir), 0).select("seg_id", F.posexplode("values").alias("at", "value"))


@query(f"WITH {LONG} SELECT dim, count(*) FILTER (WHERE v > 0.05) AS n FROM e GROUP BY dim")
def archive_dimension_counts(spark, sf_dir):
    return stats.above(lineitem_frames(spark, sf_dir), 0.05)


@query(f"WITH {FRAMES} SELECT epoch, f.seg_id, frame_no, n, frame_no = n - 1 AS last FROM f JOIN n USING (seg_id), range(2) r(epoch)")
def archive_frame_info(spark, sf_dir):
    return archive.frame_info(lineitem_frames(spark, sf_dir), 2)


@query(f"WITH {FRAMES} SELECT seg_id, unnest(list_sort(list_distinct(list(label)))) AS label FROM f GROUP BY seg_id")
def range_canonical(spark, sf_dir):
    """The distinct labels of each segment, in order."""
    rows = lineitem_frames(spark, sf_dir).groupBy("seg_id").agg(F.collect_list("label").alias("l"))
    return rows.select("seg_id", F.explode(ranges.canonical(F.col("l"))).alias("label"))


@query("WITH o AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text, role)) SELECT conv_id, turn, role FROM o WHERE k = 1 OR before IS DISTINCT FROM role")
def text_adjacent_distinct(spark, sf_dir):
    """Turns whose role isn't that of the turn before."""
    return archive.adjacent_distinct(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text", "role"], "role").select("conv_id", "turn", "role")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def text_headers_with_content(spark, sf_dir):
    headers = table(spark, sf_dir, "customer").select("c_custkey")
    return archive.with_content(headers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# ---------------------------------------------------------------- statistics and normalisation


@query(f"WITH {LONG} SELECT dim, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, round((max(v) - avg(v)) / stddev_pop(v), 6) AS high_in_sd, round((min(v) - avg(v)) / stddev_pop(v), 6) AS low_in_sd FROM e GROUP BY dim")
def stats_norms(spark, sf_dir):
    rows = stats.norms(lineitem_frames(spark, sf_dir))
    return rows.select("dim", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("high_in_sd", 6).alias("high_in_sd"), F.round("low_in_sd", 6).alias("low_in_sd"))


@query(f"WITH {LONG} SELECT dim, round(0.5 * log2(2 * pi() * exp(1) * var_pop(v)), 6) AS bits FROM e GROUP BY dim")
def stats_self_entropy(spark, sf_dir):
    return stats.self_entropy(lineitem_frames(spark, sf_dir)).withColumn("bits", F.round("bits", 6))


def norm_sql(where: str, z: str, window: str) -> str:
    return f"WITH {LONG} SELECT seg_id, frame_no, dim, round({z}, 5) + 0.0 AS z FROM e {where} WINDOW w AS (PARTITION BY {window})"


def shown(df):
    return df.select("seg_id", "frame_no", "dim", (F.round("z", 5) + 0.0).alias("z"))


@query(norm_sql("", "(v - avg(v) OVER w) / CASE WHEN count(*) OVER w < 2 OR stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END", "seg_id, dim"))
def norm_utterance(spark, sf_dir):
    """Each segment by its own mean and population deviation."""
    return shown(stats.normalise(lineitem_frames(spark, sf_dir), [F.col("seg_id")]))


@query(norm_sql("", "(v - avg(v) OVER w) / CASE WHEN count(*) OVER w < 2 OR stddev_samp(v) OVER w = 0 THEN 1 ELSE stddev_samp(v) OVER w END", "seg_id, dim"))
def norm_utterance_sample(spark, sf_dir):
    """Each segment by its own mean and sample deviation; constants keep deviation 1."""
    return shown(stats.normalise(lineitem_frames(spark, sf_dir), [F.col("seg_id")], sample=True))


@query(norm_sql("", "(v - avg(v) OVER w) / stddev_pop(v) OVER w * 2 + 5", "label, dim"))
def norm_to_targets(spark, sf_dir):
    """Each label's frames to mean 5 and deviation 2; a group without variance is an error."""
    return shown(stats.normalise_to(lineitem_frames(spark, sf_dir), [F.col("label")], 5.0, 2.0))


@query(f"WITH {ISLANDS}, {BRIDGED}, j AS (SELECT o.user_id, value FROM o JOIN c ON o.user_id = c.user_id AND i BETWEEN start_frame AND end_frame) SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(sqrt(avg(value * value)), 6) AS rms FROM j GROUP BY user_id")
def norm_speech_only(spark, sf_dir):
    """Mean and deviation of each user's values inside speech."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("frame_no"), "value")
    inside = windows.inside(frames, windows.bridged(speech(spark, sf_dir), ["user_id"], 1, 3), ["user_id"], "frame_no")
    rows = stats.signal_statistics(inside, "user_id", "value")
    return rows.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "rms")])


@query("SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY user_id")
def sound_statistics(spark, sf_dir):
    rows = stats.signal_statistics(table(spark, sf_dir, "events"), "user_id", "value")
    return rows.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "rms")])


@query(f"WITH {POST}, me AS (SELECT seg_id, cls, sum(w * v) / sum(w) AS m FROM z GROUP BY seg_id, cls), b AS (SELECT seg_id, arg_max(cls, (m, -cls)) AS best FROM me GROUP BY seg_id), "
       "lc AS (SELECT seg_id, label, count(*) AS n FROM q GROUP BY 1, 2), l AS (SELECT seg_id, arg_max(label, (n, -label)) AS label FROM lc GROUP BY seg_id) SELECT seg_id, best, label, best = label AS \"right\" FROM b JOIN l USING (seg_id)")  # fmt: skip
def segpost_classes(spark, sf_dir):
    """The most probable class of each segment, and whether it is the commonest label."""
    return stats.segment_classes(posteriors(spark, sf_dir), F.array_max("p"))


@query(f"WITH {VECTORS}, a AS (SELECT label AS i, k, avg(x) AS v FROM (SELECT label, unnest(range(64)) AS k, unnest(features) AS x FROM v) GROUP BY 1, 2) SELECT x.i, y.i AS j, round(sum(x.v * y.v), 8) AS v FROM a x JOIN a y ON x.k = y.k GROUP BY x.i, y.i")
def matrix_product(spark, sf_dir):
    """The labels' mean vectors times their transpose."""
    rows = vectors(spark, sf_dir).select("label", F.posexplode("features").alias("k", "x")).groupBy(F.col("label").alias("i"), "k").agg(F.avg("x").alias("v"))
    return stats.products(rows, rows.select("k", F.col("i").alias("j"), "v")).withColumn("v", F.round("v", 8))


# ---------------------------------------------------------------- vector algebra


@query(listed_sql("[x[1] + x[2], x[1] - x[2], x[1] * x[2], x[1] / x[2], -x[1], x[1] * x[1], CASE WHEN x[1] >= 0 THEN sqrt(x[1]) END, 1 / x[1], x[3] + x[1] * x[2], greatest(x[1], x[2]), least(x[1], x[2]), (x[1] + 0.5) * 3, list_sum(x)]", digits=5))
def row_algebra(spark, sf_dir):
    """Each operation of the vector algebra on a vector's first values."""
    x = lambda i: F.array(F.get("x", i))
    a, b, s = x(0), x(1), x(2)
    done = [arrays.add(a, b), arrays.subtract(a, b), arrays.multiply(a, b), arrays.divide(a, b), arrays.negative(a), arrays.square(a), arrays.root(a), arrays.reciprocal(a), arrays.multiply_add(s, a, b), arrays.larger(a, b), arrays.smaller(a, b), arrays.affine(a, [0.5], [3.0]), F.array(arrays.total(F.col("x")))]
    return listed(ten(spark, sf_dir).withColumn("y", F.concat(*done)), "y", 5)


MATRIX = [[float((i * 3 + j) % 5 - 2) for j in range(10)] for i in range(4)]


@query(listed_sql("[" + ", ".join(f"list_dot_product(x, [{', '.join(f'{v}::DOUBLE' for v in r)}])" for r in MATRIX) + "]"))
def row_matrix_times(spark, sf_dir):
    return listed(ten(spark, sf_dir).withColumn("y", arrays.matrix_times(MATRIX, F.col("x"))), "y")


@query(listed_sql("[x[1], x[6], x[2], x[7], x[3], x[8], x[4], x[9], x[5], x[10]]"))
def row_transposed(spark, sf_dir):
    """Two rows of five as five of two."""
    rows = F.array(F.slice("x", 1, 5), F.slice("x", 6, 5))
    return listed(ten(spark, sf_dir).withColumn("y", F.flatten(arrays.transposed(rows, 5))), "y")


@query(listed_sql("list_concat(list_concat(list_transform(x, lambda v: 20 * log10(greatest(abs(v), 1e-10))), list_transform(range(1, 11), lambda i: CASE WHEN i = 1 THEN x[1] ELSE x[i] - x[i - 1] END)), list_concat(list_reverse(x), list_transform(range(1, 11), lambda i: x[i] * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 9)))))").replace("round(unnest(y), 6)", "round(unnest(y), 6) + 0.0"))
def row_signal(spark, sf_dir):
    """Decibels, differences, the reverse, and a raised-cosine window."""
    x = F.col("x")
    return listed(ten(spark, sf_dir).withColumn("y", F.concat(arrays.decibel(x), arrays.difference(x), F.reverse(x), arrays.hanning(x))), "y").withColumn("value", F.col("value") + 0.0)


@query(listed_sql("list_concat(list_transform(list_transform(x, lambda v: v * v), lambda v: ln(1 + 1000 * v)), list_transform(list_transform(x, lambda v: v * v), lambda v: (exp(v) - 1) / 1000))"))
def row_compressed(spark, sf_dir):
    """The nonlinearity ln(1 + J x) and its inverse, J = 1000."""
    q = arrays.square(F.col("x"))
    return listed(ten(spark, sf_dir).withColumn("y", F.concat(arrays.compressed(q, 1000.0), arrays.expanded(q, 1000.0))), "y")


HERTZ = [100.0 * (i + 1) ** 2 for i in range(10)]
HEARD = "[" + ", ".join(f"({f} * {f} / ({f} * {f} + 1.6e5)) ** 2 * ({f} * {f} + 1.44e6) / ({f} * {f} + 9.61e6)" for f in HERTZ) + "]"


@query(f"WITH {VECTORS}, {TEN}, h AS (SELECT vec_id, list_transform(range(1, 11), lambda i: (x[i] * x[i] * {HEARD}[i]) ** 0.33) AS y FROM t), r AS (SELECT vec_id, [y[2], y[2], y[3], y[4], y[5], y[6], y[7], y[8], y[9], y[9]] AS y FROM h) SELECT vec_id, unnest(range(10)) AS dim, round(unnest(y), 6) AS value FROM r")
def row_loudness(spark, sf_dir):
    return listed(ten(spark, sf_dir).withColumn("y", arrays.loudness(arrays.square(F.col("x")), HERTZ)), "y")


@query(f"WITH {VECTORS}, {TEN}{SOFT}, a AS (SELECT vec_id, p, lead(p) OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS q FROM u) SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 11), lambda i: (p[i] - q[i]) ** 2))), 8) AS euclid, "
       "round(list_sum(list_transform(range(1, 11), lambda i: p[i] * log2(p[i] / q[i]))), 8) AS kl, round(list_sum(list_transform(range(1, 11), lambda i: 0.5 * (p[i] - q[i]) * log2(p[i] / q[i]))), 8) AS symmetric, round(-ln(list_dot_product(p, q)), 8) AS log_dot, round(1 - list_cosine_similarity(p, q), 8) AS cosine FROM a WHERE q IS NOT NULL")  # fmt: skip
def row_distances(spark, sf_dir):
    """Distances of each posterior to the next of its file."""
    w = Window.partitionBy("file").orderBy("vec_id")
    rows = ten(spark, sf_dir).withColumn("p", arrays.softmax(F.col("x"))).withColumn("q", F.lead("p").over(w)).where("q IS NOT NULL")
    p, q = F.col("p"), F.col("q")
    cosine = 1 - arrays.dot(p, q) / (arrays.norm(p) * arrays.norm(q))
    found = {"euclid": arrays.euclidean(p, q), "kl": arrays.kl(p, q), "symmetric": arrays.symmetric_kl(p, q), "log_dot": arrays.log_product(p, q), "cosine": cosine}
    return rows.select("vec_id", *[F.round(c, 8).alias(n) for n, c in found.items()])


@query(f"WITH {VECTORS}, {TEN}{SOFT} SELECT vec_id, 1.0::DOUBLE AS uniform, round(-1 / list_sum(list_transform(p, lambda y: y * log2(y))), 6) AS inverse_entropy, round(list_sum(list_transform(p, lambda y: y * log2(y))), 6) AS negative_entropy FROM u")
def row_confidence_by_entropy(spark, sf_dir):
    rows = ten(spark, sf_dir).withColumn("p", arrays.softmax(F.col("x")))
    p = F.col("p")
    return rows.select("vec_id", F.lit(1.0).alias("uniform"), F.round(arrays.inverse_entropy(p), 6).alias("inverse_entropy"), F.round(-arrays.entropy(p), 6).alias("negative_entropy"))


# ---------------------------------------------------------------- windows

DELTAS = filter_sql(windows.delta_weights(5)).split("SELECT seg_id, frame_no, ", 1)[1].split(" FROM f WINDOW")[0]
DOUBLE = filter_sql(windows.double_delta_weights(5)).split("SELECT seg_id, frame_no, ", 1)[1].split(" FROM f WINDOW")[0]
OVER = "WINDOW w AS (PARTITION BY seg_id ORDER BY frame_no), a AS (PARTITION BY seg_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def renamed(columns: str, by: int) -> str:
    return re.sub(r" AS f(\d+)", lambda m: f" AS f{int(m[1]) + by}", columns)


@query(f"WITH {FRAMES} SELECT seg_id, frame_no, " + ", ".join(f"round(features[{d + 1}], 4) + 0.0 AS f{d}" for d in range(4)) + f", {renamed(DELTAS, 4)}, {renamed(DOUBLE, 8)} FROM f {OVER}")
def win_with_deltas(spark, sf_dir):
    rows = windows.with_deltas(lineitem_frames(spark, sf_dir), 5, 4)
    return rows.select("seg_id", "frame_no", *[(F.round(F.get("features", i), 4) + 0.0).alias(f"f{i}") for i in range(12)])


@query(filter_sql(windows.SEVEN_TAPS))
def win_double_delta_seven(spark, sf_dir):
    return filtered(spark, sf_dir, windows.SEVEN_TAPS)


@query(f"WITH {FRAMES} SELECT seg_id, frame_no, lead(features, 2) OVER (PARTITION BY seg_id ORDER BY frame_no)[1] AS ahead FROM f")
def win_ahead(spark, sf_dir):
    return windows.ahead(lineitem_frames(spark, sf_dir), 2).select("seg_id", "frame_no", F.get("ahead", 0).alias("ahead"))


@query(f"WITH {FRAMES}, b AS (SELECT seg_id, frame_no, (seg_id * 8 + frame_no) // 100 AS bucket FROM f) SELECT seg_id, frame_no, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat_ws(':', '{7 + 12345 * 3}', seg_id, frame_no)), seg_id, frame_no) - 1 AS place FROM b")
def win_shuffled(spark, sf_dir):
    """Frames in buckets of a hundred places, in the order of the fourth epoch."""
    rows = lineitem_frames(spark, sf_dir).withColumn("number", F.col("seg_id") * 8 + F.col("frame_no"))
    return windows.shuffled(rows, ["seg_id", "frame_no"], 100, 7, 3).select("seg_id", "frame_no", "bucket", "place")


@query("WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), x AS (SELECT user_id, value, unnest(range(CAST(greatest(ceil((i - 9) / 5.0), 0) AS BIGINT), i // 5 + 1)) AS w FROM o) SELECT user_id, w * 5 AS \"start\", count(*) AS n, round(avg(value), 6) AS mean FROM x GROUP BY user_id, w")
def win_counted(spark, sf_dir):
    """Means of ten values every five values, short windows at the end too."""
    return windows.counted(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 10, 5).withColumn("mean", F.round("mean", 6))


@query("WITH o AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id HAVING count(*) > 8), f AS (SELECT user_id, x, unnest(range(0, (len(x) + 7) // 8)) AS frame_no FROM o) "
       "SELECT user_id, frame_no, frame_no * 8 AS centre, round(list_sum(list_transform(range(frame_no * 8 - 8, frame_no * 8 + 8), lambda t: x[CASE WHEN t < 0 THEN -t WHEN t >= len(x) THEN 2 * (len(x) - 1) - t ELSE t END + 1] * (t - frame_no * 8 + 9))), 4) AS weighed, CAST(16 AS INTEGER) AS n FROM f")  # fmt: skip
def front_reflected(spark, sf_dir):
    """Frames of 16 around every eighth value, mirrored at the ends; a weighted sum stands for the samples."""
    many = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumn("__c", F.count("*").over(many)).where("__c > 8")
    rows = windows.reflected(rows, "user_id", ["ts", "event_id"], "value", 16, 8)
    weighed = F.aggregate(F.transform("samples", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("user_id", "frame_no", "centre", F.round(weighed, 4).alias("weighed"), F.size("samples").alias("n"))


@query("SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 2) - 1 AS node FROM conversations")
def lattice_nodes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("half", F.floor(F.col("turn") / 2))
    return windows.ranks_in_time(rows, "conv_id", "half").select("conv_id", "turn", "node")
