"""Queries of fitted models: mixtures of feature pairs, speech thresholds, noise levels, words in slices, network training."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import arrays
from framewright.operators import archive, frontend, matching, mixtures, network, segmental, sound
from framewright.operators.graph import shared_folder, written
from framewright.plans.catalogue import DOTS, FRAMES, VECTORS, found_dots, query
from framewright.sources.frames import lineitem_frames, table, vectors

# ---------------------------------------------------------------- mixtures of feature pairs

PARTS = 2
MOMENTS = "sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * y * y) AS wyy, sum(w * x * y) AS wxy"
FITTED = "wx / w AS mx, wy / w AS my, wxx / w - (wx / w) ** 2 AS xx, wyy / w - (wy / w) ** 2 AS yy, wxy / w - wx / w * wy / w AS xy"


def em_sql(rounds: int) -> str:
    """Mixtures of PARTS components for each pair of the four features of an order line."""
    out = f"""pr AS MATERIALIZED (SELECT seg_id, frame_no, i, j, features[i + 1] AS x, features[j + 1] AS y FROM f, range(4) a(i), range(4) b(j) WHERE i < j),
al AS (SELECT i, j, w, {FITTED} FROM (SELECT i, j, {MOMENTS} FROM (SELECT *, 1.0::DOUBLE AS w FROM pr) GROUP BY i, j)),
m0 AS MATERIALIZED (SELECT i, j, c, 1.0::DOUBLE / {PARTS} AS p, mx + ((2 * c + 1) / {PARTS}::DOUBLE - 1) * sqrt(xx) AS mx, my + ((2 * c + 1) / {PARTS}::DOUBLE - 1) * CASE WHEN xy < 0 THEN -sqrt(yy) ELSE sqrt(yy) END AS my, xx, yy, 0.0::DOUBLE AS xy FROM al, range({PARTS}) r(c))"""
    for r in range(rounds + 1):
        out += f""",
d{r} AS MATERIALIZED (SELECT i, j, c, x, y, d, sum(d) OVER (PARTITION BY i, j, seg_id, frame_no) AS whole FROM (SELECT pr.*, c, p * exp(-(yy * (x - mx) ** 2 - 2 * xy * (x - mx) * (y - my) + xx * (y - my) ** 2) / (xx * yy - xy * xy) / 2) / (2 * pi() * sqrt(xx * yy - xy * xy)) AS d FROM pr JOIN m{r} USING (i, j)))"""
        if r < rounds:
            out += f""",
s{r} AS (SELECT i, j, c, {MOMENTS} FROM (SELECT *, CASE WHEN whole > 0 THEN d / whole ELSE 1.0 / {PARTS} END AS w FROM d{r}) GROUP BY i, j, c),
g{r} AS (SELECT q.i, q.j, c, q.w / al.w AS p, q.mx, q.my, greatest(q.xx, {mixtures.FLOOR} * al.xx) AS xx, greatest(q.yy, {mixtures.FLOOR} * al.yy) AS yy, q.xy FROM (SELECT i, j, c, w, {FITTED} FROM s{r}) q JOIN al USING (i, j)),
m{r + 1} AS MATERIALIZED (SELECT i, j, c, p, mx, my, xx, yy, greatest(-0.999 * sqrt(xx * yy), least(0.999 * sqrt(xx * yy), xy)) AS xy FROM g{r})"""
    return out


@query(f"WITH {FRAMES}, {em_sql(2)}, l AS (SELECT i, j, sum(ln(greatest(whole, 1e-300))) AS l FROM d2 WHERE c = 0 GROUP BY i, j) SELECT i::INTEGER AS i, j::INTEGER AS j, c::INTEGER AS c, round(p, 6) AS weight, round(mx, 4) AS mx, round(my, 4) AS my, round(xy / sqrt(xx * yy), 5) AS rho, round(l, 1) AS log_likelihood FROM m2 JOIN l USING (i, j)")
def mixture_pairs(spark, sf_dir):
    """Two normals for each pair of features after two rounds, and their log likelihood."""
    found, likelihoods = mixtures.pair_mixtures(lineitem_frames(spark, sf_dir), 4, PARTS, 2)
    rows = [(i, j, c, m.weight, m.mx, m.my, m.xy / (m.xx * m.yy) ** 0.5, likelihoods[-1][i, j]) for (i, j), ms in found.items() for c, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "i int, j int, c int, weight double, mx double, my double, rho double, log_likelihood double")
    return df.select("i", "j", "c", F.round("weight", 6).alias("weight"), F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"), F.round("rho", 5).alias("rho"), F.round("log_likelihood", 1).alias("log_likelihood"))


GRID = 60


@query(f"""WITH {FRAMES}, {em_sql(2)}, ed AS (SELECT i, j, min(mx - 4 * sqrt(xx)) AS x0, max(mx + 4 * sqrt(xx)) AS x1, min(my - 4 * sqrt(yy)) AS y0, max(my + 4 * sqrt(yy)) AS y1 FROM m2 GROUP BY i, j),
gr AS (SELECT i, j, a, b, x0 + (x1 - x0) * a / {GRID - 1} AS x, y0 + (y1 - y0) * b / {GRID - 1} AS y FROM ed, range({GRID}) s(a), range({GRID}) t(b)),
de AS (SELECT i, j, a, b, sum(p * exp(-(yy * (x - mx) ** 2 - 2 * xy * (x - mx) * (y - my) + xx * (y - my) ** 2) / (2 * (xx * yy - xy * xy))) / (2 * pi() * sqrt(xx * yy - xy * xy))) AS d FROM gr JOIN m2 USING (i, j) GROUP BY ALL),
no AS (SELECT i, j, a, b, d / sum(d) OVER (PARTITION BY i, j) AS d FROM de),
bi AS (SELECT i, j, sum(CASE WHEN d > 0 THEN d * log2(d / (da * db)) ELSE 0 END) AS bits FROM (SELECT *, sum(d) OVER (PARTITION BY i, j, a) AS da, sum(d) OVER (PARTITION BY i, j, b) AS db FROM no) GROUP BY i, j),
bo AS (SELECT i AS feature, j AS other, bits FROM bi UNION ALL SELECT j, i, bits FROM bi)
SELECT feature::INTEGER AS feature, count(*) AS n, round(avg(bits), 4) AS mean, round(max(bits), 4) AS most, arg_min(other, (-bits, other))::INTEGER AS "with" FROM bo GROUP BY feature""")
def mixture_information(spark, sf_dir):
    """What each feature shares with the others: information under two normals for each pair, rolled up."""
    info = mixtures.mixture_information(lineitem_frames(spark, sf_dir), 4, PARTS, 2)
    return mixtures.rolled_up(info).withColumns({"mean": F.round("mean", 4), "most": F.round("most", 4)})


# ---------------------------------------------------------------- speech and noise


def user_energy(spark, sf_dir) -> DataFrame:
    """A user's events as a file of frames: the energy is the square of the value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_id", (F.col("value") * F.col("value")).alias("energy"))


@query()
def speech_thresholds(spark, sf_dir):
    """The level of log energy from which on a frame of a user counts as speech, and how many do."""
    rows = mixtures.speech_frames(user_energy(spark, sf_dir))
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("speech").cast("long")).alias("n_speech"))


REACH, STEP, LEVELS = 3, 8, 30


@query(f"""WITH us AS (SELECT user_id AS seg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, [abs(value), abs(value) % 10] AS m FROM events),
va AS (SELECT seg_id, frame_no // {STEP} AS block, band, m[band + 1] AS v FROM us, range(2) r(band)),
la AS (SELECT seg_id, max(block) AS last FROM va GROUP BY seg_id),
wi AS (SELECT va.*, unnest(range(block, least(block + {REACH}, last + 1))) AS w FROM va JOIN la USING (seg_id)),
bi AS (SELECT seg_id, band, w, top, CASE WHEN top > 0 THEN least(floor(v * {LEVELS} / top), {LEVELS - 1}) ELSE 0 END AS bin FROM (SELECT *, max(v) OVER (PARTITION BY seg_id, band, w) AS top FROM wi)),
ct AS (SELECT seg_id, band, w, top, bin, count(*) AS n FROM bi GROUP BY ALL)
SELECT seg_id, band::INTEGER AS band, (w + 1) * {STEP} - 1 AS frame_no, round(any_value(top) * (arg_min(bin, (-n, bin)) + 0.5) / {LEVELS}, 6) AS level FROM ct GROUP BY seg_id, band, w""")
def noise_levels(spark, sf_dir):
    """The commonest level of two bands of a user's values over the last 24 frames, after every eighth."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    bands = table(spark, sf_dir, "events").select(F.col("user_id").alias("seg_id"), number.alias("frame_no"), F.array(F.abs("value"), F.abs("value") % 10).alias("magnitudes"))
    return mixtures.noise_levels(bands, REACH, STEP, LEVELS).withColumn("level", F.round("level", 6))


# ---------------------------------------------------------------- words in slices

# With two slices a cut is one place: the costs before and after it are running sums.
CUTS = f"""WITH {FRAMES}, sq AS (SELECT seg_id, label, features, row_number() OVER (PARTITION BY seg_id, label ORDER BY frame_no) - 1 AS t, count(*) OVER (PARTITION BY seg_id, label) AS n FROM f),
e0 AS (SELECT *, CASE WHEN n > 1 AND t >= n // 2 THEN 1 ELSE 0 END AS s FROM sq),"""


def cut_sql(r: int) -> str:
    dist = lambda m: "+".join(f"(features[{k}] - {m}[{k}]) ** 2" for k in range(1, 5))
    return f"""c{r} AS MATERIALIZED (SELECT label, s, [avg(features[1]), avg(features[2]), avg(features[3]), avg(features[4])] AS c, count(*) AS n FROM e{r} GROUP BY label, s),
k{r} AS (SELECT q.*, {dist('a.c')} AS d0, {dist('b.c')} AS d1 FROM sq q JOIN c{r} a ON a.label = q.label AND a.s = 0 JOIN c{r} b ON b.label = q.label AND b.s = 1),
o{r} AS (SELECT seg_id, label, t, sum(d0) OVER p - d0 + sum(d1) OVER f AS cost FROM k{r} WINDOW p AS (PARTITION BY seg_id, label ORDER BY t ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY seg_id, label ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
b{r} AS MATERIALIZED (SELECT seg_id, label, arg_min(t, (cost, t)) AS cut FROM o{r} WHERE t > 0 GROUP BY seg_id, label),
e{r + 1} AS MATERIALIZED (SELECT sq.*, CASE WHEN t >= coalesce(cut, n) THEN 1 ELSE 0 END AS s FROM sq LEFT JOIN b{r} USING (seg_id, label))"""


@query(f"""{CUTS} {cut_sql(0)}, {cut_sql(1)}, c2 AS (SELECT label, s, [avg(features[1]), avg(features[2]), avg(features[3]), avg(features[4])] AS c, count(*) AS n FROM e2 GROUP BY label, s)
SELECT label::INTEGER AS label, s::INTEGER AS slice, n, round(c[1], 4) AS c0, round(c[2], 2) AS c1 FROM c2""")
def kmeans_viterbi(spark, sf_dir):
    """An order's lines of one flag as a word of two slices: the means after two rounds of cutting and averaging."""
    means, _, _ = segmental.viterbi_kmeans(lineitem_frames(spark, sf_dir), ["seg_id", "label"], ["frame_no"], 4, 2, 2)
    return means.select("label", "slice", "n", F.round(F.get("centre", 0), 4).alias("c0"), F.round(F.get("centre", 1), 2).alias("c1"))


# ---------------------------------------------------------------- training


@query()
def mlp_trained_in_bunches(spark, sf_dir):
    """A network that learns the signs of a vector's first two values, trained in bunches with every epoch stored: what each epoch reached on the held-out tenth."""
    signs = 2 * (F.get("features", 0) > 0).cast("int") + (F.get("features", 1) > 0).cast("int")
    rows = written(vectors(spark, sf_dir).select("vec_id", "features", signs.alias("label")))
    folder = f"{shared_folder(spark)}/epochs-{uuid.uuid4().hex}"
    _, seen = network.train_in_bunches(rows.where("vec_id % 10 <> 0"), [32], 4, rows.where("vec_id % 10 = 0"), folder, epochs=4, rate=2.0, bunch=16)
    return spark.createDataFrame([(s["epoch"], s["rate"], s["loss"], s["accuracy"]) for s in seen], "epoch int, rate double, loss double, accuracy double")


# ---------------------------------------------------------------- sound, chains

UP, DOWN, CROSS = 3, 2, 4


@query(f"""WITH us AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value FROM events),
n AS (SELECT user_id, ceil((max(k) + 1) * {UP} / {DOWN}::DOUBLE)::BIGINT AS n FROM us GROUP BY user_id),
o AS (SELECT user_id, unnest(range(n)) AS sample_no FROM n),
w AS (SELECT o.user_id, sample_no, value, sample_no * {DOWN} / {UP}::DOUBLE - k AS t FROM o JOIN us ON us.user_id = o.user_id AND abs(sample_no * {DOWN} / {UP}::DOUBLE - k) < {CROSS}),
s AS (SELECT user_id, sample_no, sum(value * CASE WHEN abs(t) < 1e-12 THEN 1 ELSE sin(pi() * t) / (pi() * t) END * (0.5 + 0.5 * cos(pi() * t / {CROSS}))) AS s FROM w GROUP BY user_id, sample_no)
SELECT user_id, sample_no, round(coalesce(s, 0), 5) AS value FROM o LEFT JOIN s USING (user_id, sample_no)""")
def sound_resampled(spark, sf_dir):
    """A user's values as a signal, at one and a half times its rate, in chunks of 32."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    signal = table(spark, sf_dir, "events").select(F.col("user_id").alias("by"), number.cast("long").alias("sample_no"), "value")
    return sound.resampled(signal, DOWN, UP, 32, CROSS).select(F.col("by").alias("user_id"), "sample_no", F.round("value", 5).alias("value"))


@query(f"""WITH {VECTORS}, co AS (SELECT vec_id, lag, list_sum(list_transform(range(1, 65 - lag), lambda i: features[i] * features[i + lag])) / sqrt(list_sum(list_transform(range(1, 65 - lag), lambda i: features[i] ** 2)) * list_sum(list_transform(range(1, 65 - lag), lambda i: features[i + lag] ** 2))) AS r FROM v, range(3, 34) s(lag)),
pk AS (SELECT vec_id, lag, r FROM co WINDOW w AS (PARTITION BY vec_id ORDER BY lag) QUALIFY r >= lag(r) OVER w AND r >= lead(r) OVER w),
hi AS (SELECT vec_id, max(r) AS top FROM pk GROUP BY vec_id)
SELECT v.vec_id, coalesce(CASE WHEN any_value(top) >= 0.3 THEN 8000 / (min(pk.lag) FILTER (WHERE r >= 0.97 * top))::DOUBLE END, 0.0) AS pitch, round(greatest(coalesce(any_value(top), 0), 0), 8) AS periodicity FROM v LEFT JOIN hi USING (vec_id) LEFT JOIN pk USING (vec_id) GROUP BY v.vec_id""")
def front_pitch(spark, sf_dir):
    """A vector as a frame of 64 samples: its pitch by the peak of the autocorrelation."""
    return sound.pitched(vectors(spark, sf_dir), 8000, 250, 2000).select("vec_id", "pitch", F.round("periodicity", 8).alias("periodicity"))


@query(f"WITH RECURSIVE {DOTS}, d AS (SELECT DISTINCT file, (xp - yp) // 2 AS x, (xp + yp) // 2 AS y FROM dt WHERE val > 0.4), c AS (SELECT file, x, y, 1 AS n FROM d UNION SELECT d.file, d.x, d.y, c.n + 1 FROM c JOIN d ON d.file = c.file AND d.x > c.x AND d.y > c.y) SELECT file, max(n)::BIGINT AS length FROM c GROUP BY file")
def dots_longest_chain(spark, sf_dir):
    """The longest chain of dots over 0.4 of each file."""
    dots = found_dots(spark, sf_dir).where("val > 0.4").select("file", ((F.col("xp") - F.col("yp")) / 2).cast("long").alias("x"), ((F.col("xp") + F.col("yp")) / 2).cast("long").alias("y"))
    return matching.longest_chains(dots)


# ---------------------------------------------------------------- cepstra, silence, slopes


@query()
def front_cepstral_features(spark, sf_dir):
    """A user's values as a signal, brought to half as many samples again, framed, as cepstra with deltas and second deltas."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    signal = table(spark, sf_dir, "events").select(F.col("user_id").alias("by"), number.cast("long").alias("sample_no"), "value")
    rows = frontend.cepstral_features(signal, 100, 150, 24, 12, 32, 8, 5)
    return rows.select("seg_id", "frame_no", F.posexplode("features").alias("k", "value")).withColumn("value", F.round("value", 6))


NOISE = "(list_sum(list_transform(range(8), lambda q: (('0x' || md5({})[4 * q + 1:4 * q + 4])::BIGINT + 0.5::DOUBLE) / 65536)) - 4) * sqrt(1.5)"


def silence_sql(side: str, of: str, at: str, label: str) -> str:
    value = f"2 * m[d] + 1 + (0.5 * s[d] + 0.25) * {NOISE.format(chr(39) + '7:' + chr(39) + ' || st.seg_id || ' + chr(39) + f':{side}:' + chr(39) + ' || k || ' + chr(39) + ':' + chr(39) + ' || (d - 1)')}"
    stats = ", ".join(f"avg(features[{i}])" for i in range(1, 5)), ", ".join(f"stddev_pop(features[{i}])" for i in range(1, 5))
    return f"SELECT st.seg_id, {at} + k AS frame_no, list_transform(range(1, 5), lambda d: {value}) AS features, label FROM (SELECT seg_id, any_value(n) AS n, [{stats[0]}] AS m, [{stats[1]}] AS s, {label}(label, frame_no) AS label FROM fn WHERE {of} GROUP BY seg_id) st, range(2) r(k)"


@query(f"""WITH {FRAMES}, fn AS (SELECT f.*, n FROM f JOIN n USING (seg_id)), a AS (SELECT seg_id, frame_no + 2 AS frame_no, features, label FROM fn
UNION ALL {silence_sql('before', 'frame_no < 3', '0', 'arg_min')} UNION ALL {silence_sql('after', 'frame_no >= n - 3', 'n + 2', 'arg_max')})
SELECT seg_id, frame_no, label, round(features[1], 5) AS f0, round(features[2], 3) AS f1, round(features[3], 6) AS f2 FROM a""")
def archive_with_silence(spark, sf_dir):
    """Two made-up frames ahead of each segment and two behind, around the statistics of its first and last three."""
    rows = archive.with_silence(lineitem_frames(spark, sf_dir).drop("l_linestatus"), 4, 2, 2, 3, (2.0, 1.0), (0.5, 0.25), 7)
    return rows.select("seg_id", "frame_no", "label", F.round(F.get("features", 0), 5).alias("f0"), F.round(F.get("features", 1), 3).alias("f1"), F.round(F.get("features", 2), 6).alias("f2"))


@query(f"""WITH {VECTORS}, y AS (SELECT vec_id, list_transform(features, lambda v: 1 / (1 + exp(-v))) AS s, list_transform(features, lambda v: tanh(v)) AS t, features AS d FROM v),
e AS (SELECT *, list_transform(d, lambda v: exp(v - list_max(d))) AS e FROM y), p AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
SELECT vec_id, i::INTEGER AS i, round(s[i + 1] * (1 - s[i + 1]), 8) AS sigmoid, round(1 - t[i + 1] ** 2, 8) AS tanh, round(p[i + 1] * (d[i + 1] - list_dot_product(p, d)), 8) AS softmax FROM p, range(64) r(i)""")
def row_slopes(spark, sf_dir):
    """Derivatives of the outputs of a layer: logistic, hyperbolic tangent, softmax."""
    x = F.col("features")
    rows = vectors(spark, sf_dir).withColumn("p", arrays.softmax(x))
    slopes = {"sigmoid": arrays.sigmoid_slope(F.transform(x, lambda v: 1 / (1 + F.exp(-v)))), "tanh": arrays.tanh_slope(F.transform(x, lambda v: F.tanh(v))), "softmax": arrays.softmax_slope(F.col("p"), x)}
    rows = rows.select("vec_id", *[a.alias(n) for n, a in slopes.items()])
    return rows.select("vec_id", F.posexplode(F.arrays_zip(*slopes)).alias("i", "z")).select("vec_id", "i", *[F.round(F.col("z")[n], 8).alias(n) for n in slopes])
