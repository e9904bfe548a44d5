"""Queries of evaluation by speaker, of pair selection and of match scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framewright.operators import evaluation, lsh, matching, nearest, pairing
from framewright.operators.graph import shared_folder
from framewright.plans.catalogue import ABX, BITS, DIMS, DOTS, HOUGH, MEDIAN, NODES, PAIRS, PEAKS, RUNS, SIGNED, SQL, VECTORS, found_dots, grades, interval_nodes, matches_and_peaks, query, signed, signed_distances, signed_pairs
from framewright.sources.frames import table, vectors

# ---------------------------------------------------------------- evaluation by speaker

KINDS = """kd AS (SELECT dist, kind, good FROM (SELECT dist, unnest(['overall', 'same_speaker', 'different_speaker', 'speaker_id']) AS kind,
  unnest([true, same_speaker, NOT same_speaker, same OR NOT same_speaker]) AS use, unnest([same, same, same, same_speaker]) AS good FROM p) WHERE use),
kc AS (SELECT kind, dist, count(*) AS n, sum(CAST(good AS INTEGER)) AS pos FROM kd GROUP BY kind, dist),
kr AS (SELECT *, sum(pos) OVER w / sum(n) OVER w AS precision FROM kc WINDOW w AS (PARTITION BY kind ORDER BY dist))"""
POINTS = """pa AS (SELECT dist, same, same_speaker, count(*) AS w FROM p GROUP BY ALL), mx AS (SELECT max(dist) AS top FROM pa), gr AS (SELECT k, k * top / 100 AS x FROM range(100) r(k), mx),
pt AS (SELECT k, any_value(x) AS x, coalesce(sum(w) FILTER (WHERE same AND dist <= x), 0) AS good, coalesce(sum(w) FILTER (WHERE dist <= x), 0) AS n,
  coalesce(sum(w) FILTER (WHERE same AND same_speaker AND dist <= x), 0) / sum(w) FILTER (WHERE same AND same_speaker) AS recall_same,
  coalesce(sum(w) FILTER (WHERE same AND NOT same_speaker AND dist <= x), 0) / sum(w) FILTER (WHERE same AND NOT same_speaker) AS recall_different FROM gr, pa GROUP BY k),
po AS (SELECT k, x, CASE WHEN n > 0 THEN good / n ELSE 0 END AS precision, recall_same, recall_different FROM pt)"""


@query(f"WITH {SIGNED}, {PAIRS}, {KINDS} SELECT kind, CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(pos) AS BIGINT) AS n_good, round(sum(pos * precision) / sum(pos), 8) AS ap FROM kr GROUP BY kind")
def eval_average_precision_speakers(spark, sf_dir):
    return evaluation.average_precisions(signed_distances(spark, sf_dir)).withColumn("ap", F.round("ap", 8))


@query(f"WITH {SIGNED}, {PAIRS}, {POINTS} SELECT CAST(k AS INTEGER) AS k, round(x, 8) AS x, round(precision, 8) AS precision, round(recall_same, 8) AS recall_same, round(recall_different, 8) AS recall_different FROM po")
def samediff_thresholds(spark, sf_dir):
    rows = evaluation.at_thresholds(signed_distances(spark, sf_dir))
    return rows.select("k", *[F.round(c, 8).alias(c) for c in ("x", "precision", "recall_same", "recall_different")])


@query(f"WITH {SIGNED}, {PAIRS}, {POINTS} SELECT round((SELECT (precision + recall_same) / 2 FROM po WHERE recall_same > 0.01 ORDER BY abs(precision - recall_same), k LIMIT 1), 8) AS same_speaker, round((SELECT (precision + recall_different) / 2 FROM po WHERE recall_different > 0.01 ORDER BY abs(precision - recall_different), k LIMIT 1), 8) AS different_speaker")
def samediff_breakevens(spark, sf_dir):
    rows = evaluation.breakevens(evaluation.at_thresholds(signed_distances(spark, sf_dir)))
    return rows.select(*[F.round(c, 8).alias(c) for c in rows.columns])


MOMENTS = ", ".join(f"avg(dist) FILTER (WHERE {c}) AS m{k}, var_samp(dist) FILTER (WHERE {c}) AS v{k}" for k, c in (("1", "same AND same_speaker"), ("2", "same AND NOT same_speaker"), ("12", "same"), ("34", "NOT same")))


@query(f"WITH {SIGNED}, {PAIRS}, q AS (SELECT {MOMENTS} FROM p), r AS (SELECT (m1 - m2) ** 2 / (v1 + v2) AS s_1_2, (m12 - m34) ** 2 / (v12 + v34) AS s_12_34 FROM q) SELECT round(s_1_2, 8) AS s_1_2, round(s_12_34, 8) AS s_12_34, round(s_12_34 / s_1_2, 6) AS ratio FROM r")
def samediff_separabilities(spark, sf_dir):
    return evaluation.separabilities(signed_pairs(spark, sf_dir)).select(F.round("s_1_2", 8).alias("s_1_2"), F.round("s_12_34", 8).alias("s_12_34"), F.round("ratio", 6).alias("ratio"))


# ---------------------------------------------------------------- pairs

FILES = "fl AS (SELECT DISTINCT o_custkey AS file FROM orders WHERE o_custkey % 10 = 0)"


def files(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_custkey % 10 = 0").select(F.col("o_custkey").alias("file"))


@query("WITH fl AS (SELECT DISTINCT o_custkey AS file FROM orders) SELECT file, dense_rank() OVER (ORDER BY file) - 1 AS number FROM fl")
def files_numbered(spark, sf_dir):
    """The distinct files in order, numbered."""
    return pairing.numbered(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file")), "file")


@query(f"WITH {FILES} SELECT a.file AS a, b.file AS b FROM fl a JOIN fl b ON a.file <= b.file")
def files_all_pairs(spark, sf_dir):
    """Every pair of the files that a list names, a file with itself too."""
    return pairing.triangle(files(spark, sf_dir).distinct(), "file")


@query("WITH fl AS (SELECT DISTINCT o_custkey AS file FROM orders), n AS (SELECT file, dense_rank() OVER (ORDER BY file) - 1 AS number, count(*) OVER () AS total FROM fl), d AS (SELECT file AS a, unnest(range(1, 5)) AS draw, total FROM n) "
       "SELECT file AS a, file AS b, CAST(0 AS INTEGER) AS draw FROM n UNION ALL SELECT d.a, n.file AS b, CAST(draw AS INTEGER) AS draw FROM d JOIN n ON n.number = ((d.a * 7919 + draw * 104729) % 1000003) % d.total")  # fmt: skip
def files_beam_pairs(spark, sf_dir):
    """Each file with itself and four drawn ones."""
    return pairing.drawn(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file")), "file", 5)


CLUSTERS = "cl AS (SELECT vec_id AS node, label * 10 + vec_id % 10 AS cluster FROM embeddings)"


def vector_clusters(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), (F.col("label") * 10 + F.col("vec_id") % 10).alias("cluster"))


@query(f"WITH {CLUSTERS}, z AS (SELECT cluster FROM cl GROUP BY cluster HAVING count(*) BETWEEN 2 AND 40) SELECT x.cluster, x.node AS a, y.node AS b FROM cl x JOIN cl y ON x.cluster = y.cluster AND x.node < y.node WHERE x.cluster IN (SELECT cluster FROM z)")
def cluster_pairs(spark, sf_dir):
    """Pairs of nodes of clusters that have between 2 and 40."""
    return pairing.within(pairing.sized(vector_clusters(spark, sf_dir), 2, 40))


@query(f"WITH {CLUSTERS}, z AS (SELECT cluster FROM cl GROUP BY cluster HAVING count(*) < 60 AND sum(length(CAST(node AS VARCHAR)) + 1) - 1 < 300) SELECT cluster, node FROM cl WHERE cluster IN (SELECT cluster FROM z)")
def cluster_garbage_filter(spark, sf_dir):
    """Clusters of fewer than 60 nodes whose line is shorter than 300 characters."""
    return pairing.plausible(vector_clusters(spark, sf_dir), 60, 300)


@query(f"WITH {NODES}, c AS (SELECT node, file % 50 AS cluster FROM nd) SELECT cluster, c.node, nd.file, nd.\"start\", nd.\"end\" FROM c JOIN nd USING (node)")
def cluster_lookup(spark, sf_dir):
    """What a cluster's nodes are."""
    nodes = interval_nodes(spark, sf_dir)
    return pairing.looked_up(nodes.select("node", (F.col("file") % 50).alias("cluster")), nodes)


WORDS = """tr AS (SELECT o_custkey AS file, epoch(o_orderdate) // 86400 AS t, o_orderkey FROM orders),
w AS (SELECT file, t AS "start", t + 20 + o_orderkey % 25 AS "end", 'w' || (o_orderkey % 97) AS word FROM tr)"""
COVER = "(least(w.\"end\", nd.\"end\") - greatest(w.\"start\", nd.\"start\")) / (w.\"end\" - w.\"start\")"


@query(f"WITH {NODES}, {WORDS}, h AS (SELECT node, word, w.\"start\" AS s, w.\"end\" AS e, {COVER} AS cover FROM nd JOIN w ON w.file = nd.file AND w.\"start\" < nd.\"end\" AND nd.\"start\" < w.\"end\") "
       "SELECT node, coalesce(string_agg(word, ' ' ORDER BY s, e, word) FILTER (WHERE cover >= 0.66), min_by(word, (s, e, word))) AS label FROM h GROUP BY node")  # fmt: skip
def node_labels(spark, sf_dir):
    """The words of the transcript that an interval covers to two thirds; else the first that it touches."""
    words = table(spark, sf_dir, "orders").withColumn("start", F.floor(F.unix_timestamp("o_orderdate") / 86400))
    words = words.select(F.col("o_custkey").alias("file"), "start", (F.col("start") + 20 + F.col("o_orderkey") % 25).alias("end"), F.concat(F.lit("w"), F.col("o_orderkey") % 97).alias("word"))
    return pairing.labelled(interval_nodes(spark, sf_dir), words, 0.66, 90)


@query(f"WITH {NODES} SELECT a.node AS a, b.node AS b FROM nd a JOIN nd b ON a.file = b.file AND a.node < b.node AND greatest(0.0, (a.\"end\" - a.\"start\" + b.\"end\" - b.\"start\") / (greatest(a.\"end\", b.\"end\") - least(a.\"start\", b.\"start\")) - 1) <= 0.2")
def segment_pairs_apart(spark, sf_dir):
    """Pairs of segments of a file that overlap by a fifth at most."""
    return pairing.apart(interval_nodes(spark, sf_dir), 0.2)


# ---------------------------------------------------------------- matches

MATCHES = f"{DOTS}, {MEDIAN}, {HOUGH}, {PEAKS}, {RUNS}, mt AS (SELECT file, yp, CAST(trunc((lo - yp) / 2) AS INTEGER) AS xa, CAST(trunc((hi - yp) / 2) AS INTEGER) AS xb, CAST(trunc((lo + yp) / 2) AS INTEGER) AS ya, CAST(trunc((hi + yp) / 2) AS INTEGER) AS yb, hi - lo + 1 AS len FROM ru)"


def found_matches(spark, sf_dir):
    return matches_and_peaks(spark, sf_dir)[0]


@query(f"WITH {MATCHES} SELECT file, yp, xa, xb, ya, yb FROM mt WHERE xb - xa >= 2 AND yb - ya >= 2")
def match_duration_filter(spark, sf_dir):
    return matching.lasting(found_matches(spark, sf_dir), 2)


@query(f"WITH {DOTS}, d2 AS (SELECT file, yp, xp, val FROM dt UNION ALL SELECT file, yp, xp, val FROM dt WHERE xp % 2 = 0) SELECT file, yp, xp, round(any_value(val), 6) AS val FROM d2 GROUP BY file, yp, xp")
def dots_dedup(spark, sf_dir):
    """One dot for each place."""
    dots = found_dots(spark, sf_dir)
    return matching.one_dot(dots.union(dots.where("xp % 2 = 0"))).withColumn("val", F.round("val", 6))


@query(f"WITH {VECTORS}, z AS (SELECT vec_id, file, unnest(range(64)) AS dim, unnest(features) AS x FROM v), s AS (SELECT * FROM z WHERE x > 0.15), d AS (SELECT a.vec_id AS i, b.vec_id AS j, sum(a.x * b.x) AS val FROM s a JOIN s b ON a.file = b.file AND a.dim = b.dim AND a.vec_id < b.vec_id GROUP BY 1, 2) "
       "SELECT i, j, round(val, 6) AS val FROM d WHERE val > 0.2")  # fmt: skip
def dots_sparse_product(spark, sf_dir):
    """Dot products of sparse posteriors (values over 0.15) through postings of each dimension."""
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "file", F.posexplode("features").alias("dim", "x")).where("x > 0.15")
    return matching.sparse_products(rows, 0.2).withColumn("val", F.round("val", 6))


@query(f"WITH {MATCHES} SELECT file, yp, xa, xb, ya, yb, round(1 / (1 + exp(-(0.5 * (xb - xa) + 2 * ln(greatest((xb + yb) - (xa + ya) + 1, 10)) - 6))), 8) AS score FROM mt")
def match_logistic_scores(spark, sf_dir):
    """A logistic score of a match's length, the logarithm floored at ln 10."""
    return matching.logistic(found_matches(spark, sf_dir), 0.5, 2.0, -6.0).withColumn("score", F.round("score", 8))


@query(f"WITH {SIGNED}, x AS (SELECT a.vec_id AS i, b.vec_id AS j, cos(pi() * bit_count(xor(a.sig, b.sig)) / {BITS}.0) AS s FROM g a JOIN g b ON a.file = b.file AND a.vec_id < b.vec_id) SELECT i, j, round(1 / (1 + exp(-100 * (s - 0.45))), 8) AS score FROM x WHERE s > 0.4")
def arc_sigmoid_scores(spark, sf_dir):
    own = signed(spark, sf_dir).select("vec_id", "file", "sig")
    a, b = (own.select(F.col("vec_id").alias(i), "file", F.col("sig").alias(s)) for i, s in (("i", "s"), ("j", "t")))
    rows = a.join(b, "file").where("i < j").select("i", "j", lsh.cosine(lsh.hamming(F.col("s"), F.col("t")), BITS).alias("c")).where("c > 0.4")
    return rows.select("i", "j", F.round(matching.arc_score(F.col("c"), 0.45), 8).alias("score"))


@query(f"WITH {DOTS}, b AS (SELECT file, yp, xp, least(CAST(floor(10 * yp / (SELECT max(yp) + 1 FROM dt)) AS INTEGER), 9) AS bin FROM dt) SELECT file, bin, count(*) AS n FROM b GROUP BY file, bin")
def dots_diagonal_bins(spark, sf_dir):
    """Dots of each file by their distance to the diagonal, in tenths of the largest."""
    return matching.diagonal_bins(found_dots(spark, sf_dir), 10)


@query(f"WITH {DOTS}, ax AS (SELECT file, min(xp) AS lo, max(xp) AS hi FROM dt WHERE yp = 20 GROUP BY file), bd AS (SELECT file, 20 AS yp, unnest(range(lo, hi + 1)) AS xp FROM ax) SELECT bd.file, bd.yp, bd.xp, round(coalesce(val, 0), 6) AS val FROM bd LEFT JOIN dt USING (file, yp, xp)")
def dots_dense_band(spark, sf_dir):
    """Row 20 of the match matrix with its gaps filled."""
    return matching.dense_row(found_dots(spark, sf_dir), 20).withColumn("val", F.round("val", 6))


@query(f"WITH {MATCHES} SELECT mt.file, mt.yp, xa, xb, ya, yb, round(h, 6) AS rho, round(1 / (1 + exp(-(0.5 * (xb - xa) + 2 * ln(greatest((xb + yb) - (xa + ya) + 1, 10)) - 6))), 8) AS score FROM mt JOIN pk ON pk.file = mt.file AND pk.yp = mt.yp WHERE h > 4 AND 1 / (1 + exp(-(0.5 * (xb - xa) + 2 * ln(greatest((xb + yb) - (xa + ya) + 1, 10)) - 6))) > 0.5")
def match_threshold_filter(spark, sf_dir):
    """Matches over a score and over a height of their row."""
    found, peaks = matches_and_peaks(spark, sf_dir)
    rows = matching.logistic(found, 0.5, 2.0, -6.0).join(peaks.withColumnRenamed("h", "rho"), ["file", "yp"])
    return matching.scored_over(rows, 0.5, 4.0).withColumns({"rho": F.round("rho", 6), "score": F.round("score", 8)})


@query(SQL["search_by_example"])
def search_stored_index(spark, sf_dir):
    """Every seventh vector asked against an index that was written and read."""
    own, path = signed(spark, sf_dir), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    lsh.build_index(own, "vec_id", BITS, 4, path)
    return lsh.search(spark.read.parquet(path), own.where("vec_id % 7 = 0"), "vec_id", BITS, 0.5).withColumn("cos", F.round("cos", 6))


PART_ROWS = 64
ASKED = f"""r AS (SELECT vec_id AS id, sig, p, (sig >> (p * 8)) + (sig % (1 << (p * 8))) * (1 << ({BITS} - p * 8)) % {1 << BITS} AS key FROM g, range(4) q(p)),
o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY key, id) - 1 AS place FROM r),
w AS (SELECT p, key, min(place) AS stand FROM o GROUP BY p, key),
m AS (SELECT DISTINCT x.id AS query, y.id AS id, CAST(bit_count(xor(x.sig, y.sig)) AS INTEGER) AS h FROM r x JOIN w USING (p, key) JOIN o y ON y.p = x.p AND y.place >= stand - 50 AND y.place < stand + 50 WHERE x.id % 50 = 0)"""


@query(f"WITH {SIGNED}, {ASKED} SELECT query, id, h, round(cos(pi() * h / {BITS}.0), 6) AS cos FROM m WHERE cos(pi() * h / {BITS}.0) > 0.5")
def search_placed_index(spark, sf_dir):
    """Every fiftieth vector asked against a stored index by as-of joins: the parts around each query's place are read, no others."""
    own, path = signed(spark, sf_dir), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    nearest.build(own, "vec_id", BITS, 4, path, PART_ROWS)
    found = nearest.search(spark, path, own.where("vec_id % 50 = 0"), "vec_id", BITS, 0.5, 4, part_rows=PART_ROWS)
    return found.withColumn("cos", F.round("cos", 6))


@query("WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t, event_type, value FROM events) SELECT a.event_id, a.user_id, b.t AS since, b.value AS level FROM (SELECT * FROM e WHERE event_type <> 'purchase') a ASOF LEFT JOIN (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'purchase' GROUP BY user_id, t) b ON a.user_id = b.user_id AND a.t >= b.t")
def events_asof(spark, sf_dir):
    """Each event with the last purchase of its user at or before it."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp("ts"))
    bought = rows.where("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("value").alias("level")).withColumn("since", F.col("t"))
    asked = rows.where("event_type <> 'purchase'").select("event_id", "user_id", "t")
    return nearest.asof(asked, bought, ["user_id"], "t", 86_400, ["since", "level"]).select("event_id", "user_id", "since", "level")


GAUSSIAN = lsh.gaussian_projection(DIMS, BITS, 5)


@query(f"WITH {VECTORS} SELECT vec_id, " + " + ".join(f"CASE WHEN list_dot_product(features, [{', '.join(f'{x!r}::DOUBLE' for x in row)}]) >= 0 THEN {1 << b} ELSE 0 END" for b, row in enumerate(GAUSSIAN.tolist())) + " AS sig FROM v")
def signature_gaussian(spark, sf_dir):
    """Signatures by a Gaussian projection (sums of twelve uniforms)."""
    return lsh.signature(vectors(spark, sf_dir), GAUSSIAN).select("vec_id", "sig")


@query("SELECT event_id, user_id, round(value * (1 + (user_id % 7) / 100.0), 6) AS warped FROM events")
def joined_parameters(spark, sf_dir):
    """Each user's warp factor, from a table of one row a user, applied to the user's values."""
    warp = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("warp", 1 + (F.col("user_id") % 7) / 100.0)
    return table(spark, sf_dir, "events").join(warp, "user_id").select("event_id", "user_id", F.round(F.col("value") * F.col("warp"), 6).alias("warped"))


OWN_CONTEXT = ABX.replace("a.speaker AS s_x", "a.speaker * 4 + a.vec_id % 4 AS s_x").replace("b.speaker AS s_a", "b.speaker * 4 + b.vec_id % 4 AS s_a")


@query(f"WITH {OWN_CONTEXT} SELECT round((1 - avg(m)) * 100, 6) AS error FROM (SELECT p_x, p_b, avg(m) AS m FROM (SELECT s_x, p_x, p_b, avg(score) AS m FROM tr WHERE s_a = s_x GROUP BY ALL) GROUP BY p_x, p_b)")
def abx_within_context(spark, sf_dir):
    """Minimal pairs within a speaker and a context; means by (speaker, context), then by pair of categories, then all."""
    rows = grades(spark, sf_dir)
    rows = rows.withColumns({"s_x": F.col("s_x") * 4 + F.col("context"), "s_a": F.col("s_a") * 4 + F.col("context")}).where("s_a = s_x")
    return evaluation.error_rate(evaluation.discrimination(rows), ["s_x", "p_x", "p_b"]).withColumn("error", F.round("error", 6))
