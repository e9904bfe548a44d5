"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b: long); label is the smallest node of its component.

    Alternating star contractions: each round hangs a node's larger neighbours on its smallest neighbour, then its
    smaller ones.  The edge table, written once a round, never grows; rounds grow with the logarithm of the diameter."""
    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = cut(edges.select(big, small).where("a <> b").distinct())
    alone = edges.where("a = b").select(F.col("a").alias("node"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).union(alone).distinct()
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first: then both sides of the join come straight from a shuffle, and Spark splits the rows of a hub.
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        now = cut(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b"))).where("a <> b").select(big, small).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("string")).first()
        if seen == state:
            return nodes.join(now.groupBy("a").agg(F.min("b").alias("m")), nodes["node"] == F.col("a"), "left").select("node", F.coalesce("m", "node").alias("label"))
        state = seen
