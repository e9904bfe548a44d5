"""Queries of alignment, rescoring and clustering variants, with dynamic programming in SQL as folds over lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import align, graph, words
from framewright.plans.catalogue import BITS, EDGES, NODES, REACH, SIGNED, SQL, VECTORS, interval_nodes, neighbours, order_clusters, query, signed

FAR = "'infinity'::DOUBLE"


def path_sql(pairs: str, costs: str, rows: str, columns: str, key: str, step: str = "0.0") -> str:
    """CTEs: `path` (key, i, row) with the summed costs of each row of the matrix; `pairs` is a CTE pr with key and lists; a row is a fold over its cells."""
    cell = f"lambda acc, t: list_append(acc, t[1] + least(t[2], t[3] + {step}, acc[len(acc)] + {step}))"
    return f"""{pairs}, cm AS (SELECT {key}, {rows} AS n, {columns} AS m, {costs} AS c FROM pr),
path({key}, i, row) AS (SELECT {key}, 0, list_concat([0.0::DOUBLE], list_transform(range(m), lambda j: {FAR})) FROM cm
UNION ALL SELECT path.{key}, i + 1, list_reduce(list_transform(range(m), lambda j: [c[i + 1][j + 1], row[j + 1], row[j + 2]]), {cell}, [{FAR}]) FROM path JOIN cm USING ({key}) WHERE i < n)"""


FRAMED = f"{VECTORS}, s8 AS (SELECT vec_id, file, list_transform(range(8), lambda k: list_slice(features, k * 8 + 1, k * 8 + 8)) AS x FROM v), nb AS (SELECT vec_id, lead(vec_id) OVER w AS other, x, lead(x) OVER w AS y FROM s8 WINDOW w AS (PARTITION BY file ORDER BY vec_id)), pr AS (SELECT * FROM nb WHERE other IS NOT NULL)"
COSTS = "list_transform(x, lambda a: list_transform(y, lambda b: (1 - list_cosine_similarity(a, b)) / 2))"
SQL["align_dtw"] = f"WITH RECURSIVE {path_sql(FRAMED, COSTS, '8', '8', 'vec_id')} SELECT vec_id, other, round(row[9] / 16, 8) AS cost FROM path JOIN pr USING (vec_id) WHERE i = 8"

TURNS = "tn AS (SELECT conv_id, turn, row_number() OVER () AS id, string_split(text, ' ') AS a, lead(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM conversations), pr AS (SELECT * FROM tn WHERE b IS NOT NULL)"
DIFFER = "list_transform(a, lambda p: list_transform(b, lambda q: CASE WHEN p = q THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END))"
# A gap costs 1 whatever the tokens are: the cell is the least of the two gaps and the diagonal with its own cost.
GAPS = path_sql(TURNS, DIFFER, "len(a)", "len(b)", "id").replace("t[1] + least(t[2], t[3] + 0.0, acc[len(acc)] + 0.0)", "least(t[1] + t[2], t[3] + 1, acc[len(acc)] + 1)")
SQL["align_tokens"] = f"WITH RECURSIVE {GAPS} SELECT conv_id, turn, round(row[m + 1] / (n + m), 8) AS cost FROM path JOIN cm USING (id) JOIN pr USING (id) WHERE i = n"

KEPT = 'list_reduce(list(struct_pack(node := node, s := "start", e := "end") ORDER BY {order}).list_transform(lambda q: [q]), lambda acc, t: CASE WHEN len(list_filter(acc, lambda k: greatest(k.e, t[1].e) > least(k.s, t[1].s) AND (k.e - k.s + t[1].e - t[1].s) / (greatest(k.e, t[1].e) - least(k.s, t[1].s)) - 1 >= 0.9)) = 0 THEN list_concat(acc, t) ELSE acc END)'


def kept_sql(order: str) -> str:
    return f'WITH RECURSIVE {NODES}, {EDGES}, {REACH}, gr AS (SELECT component AS cluster, file, {KEPT.format(order=order)} AS kept FROM cc JOIN nd USING (node) GROUP BY 1, 2), un AS (SELECT cluster, file, unnest(kept) AS k FROM gr) SELECT cluster, file, k.node AS node, k.s AS "start", k.e AS "end" FROM un'


SQL["graph_dedup"] = kept_sql("node")


@query(kept_sql('"end", "start", node'))
def graph_dedup_by_end(spark, sf_dir):
    """Greedy overlap dedup of each cluster's intervals in the order of their ends."""
    own = order_clusters(spark, sf_dir).withColumnRenamed("component", "cluster")
    return graph.greedy_dedup(own.join(interval_nodes(spark, sf_dir), "node"), 0.9, ("end", "start", "node"))


@query(f"WITH RECURSIVE {NODES}, {EDGES}, er AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS k FROM ed WHERE w > 0.6), es AS (SELECT a, b FROM er WHERE k <= 2), {REACH.replace('JOIN ed e', 'JOIN es e')} SELECT * FROM cc")
def graph_components_strong(spark, sf_dir):
    """Components over edges above 0.6, with two neighbours kept for each node."""
    nodes = interval_nodes(spark, sf_dir)
    return graph.components(nodes, graph.strong_edges(graph.overlap_edges(nodes, 90, 0.5), 0.6, 2))


SIGNS = f"{SIGNED}, sq AS (SELECT file, (vec_id // 20) // 5 AS part, list(sig ORDER BY vec_id) AS x FROM g GROUP BY 1, 2), nb AS (SELECT file * 1000 + part AS id, file, part, x, lead(x) OVER (PARTITION BY file ORDER BY part) AS y FROM sq), pr AS (SELECT * FROM nb WHERE y IS NOT NULL)"
SIGN_COSTS = f"list_transform(x, lambda a: list_transform(y, lambda b: (1 - CASE WHEN a = 0 OR b = 0 THEN -1 ELSE cos(pi() * bit_count(xor(a, b)) / {BITS}.0) END) / 2))"


@query(f"WITH RECURSIVE {path_sql(SIGNS, SIGN_COSTS, 'len(x)', 'len(y)', 'id')} SELECT file, part, round(row[m + 1] / (n + m), 8) AS cost FROM path JOIN cm USING (id) JOIN pr USING (id) WHERE i = n")
def align_signatures(spark, sf_dir):
    """DTW over signatures: runs of five vectors of a file beside the next five."""
    own = signed(spark, sf_dir).withColumn("part", F.floor(F.floor(F.col("vec_id") / 20) / 5))
    parts = own.groupBy("file", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "sig"))), lambda q: q["sig"]).alias("x"))
    w = Window.partitionBy("file").orderBy("part")
    rows = parts.withColumn("y", F.lead("x").over(w)).where("y IS NOT NULL")
    return rows.select("file", "part", F.round(align.signature_dtw_of(F.col("x"), F.col("y"), BITS), 8).alias("cost"))


KEYWORD = path_sql(FRAMED, "list_transform(range(8), lambda i: list_transform(range(4), lambda j: CASE WHEN abs(i - j) <= 2 THEN (1 - list_cosine_similarity(x[i + 1], y[j + 1])) / 2 ELSE 'infinity'::DOUBLE END))", "8", "4", "vec_id")


@query(f"WITH RECURSIVE {KEYWORD} SELECT vec_id, other, CAST(arg_min(i - 1, (row[5], i)) AS INTEGER) AS \"end\", round(min(row[5]), 8) AS cost FROM path JOIN pr USING (vec_id) WHERE i > 0 GROUP BY vec_id, other")
def align_keyword(spark, sf_dir):
    """Where the first four frames of the next sequence, as a whole, end best."""
    rows = neighbours(spark, sf_dir)
    found = align.keyword_of(F.col("frames"), F.slice("other_frames", 1, 4))
    return rows.select("vec_id", "other", found.alias("c")).select("vec_id", "other", "c.end", F.round("c.cost", 8).alias("cost"))


@query()
def align_rescored(spark, sf_dir):
    """Score of each sequence beside the next: run-limited DTW of frames brought to mean 0 and deviation 1."""
    rows = neighbours(spark, sf_dir)
    return rows.select("vec_id", "other", F.round(align.rescored(F.col("frames"), F.col("other_frames"), longest=3), 8).alias("score"))


@query()
def align_cast_both(spark, sf_dir):
    """Matches grown in both directions from the middle of neighbouring sequences."""
    rows = neighbours(spark, sf_dir)
    grown = align.cast_both_of(F.col("frames"), F.col("other_frames"), F.lit(4), F.lit(4))
    return rows.select("vec_id", "other", grown.alias("m")).select("vec_id", "other", "m.*")


@query()
def align_by_change(spark, sf_dir):
    """Each sequence beside the next, warped and weighed by how much frames change in their middle columns."""
    rows = neighbours(spark, sf_dir)
    return rows.select("vec_id", "other", F.round(words.change_distance(F.col("frames"), F.col("other_frames"), 2, 5, 0.9), 8).alias("cost"))


@query()
def align_with_flux(spark, sf_dir):
    """Each sequence beside the next, warped along a third axis of spectral flux."""
    rows = neighbours(spark, sf_dir)
    return rows.select("vec_id", "other", F.round(words.flux_distance(F.col("frames"), F.col("other_frames"), 9, 3, 0.9), 8).alias("cost"))
