"""Interval-overlap graphs, connected components, greedy dedup and bags of terms."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """max(0, (len a + len b) / span - 1); 0 for an empty span."""
    span = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(span > 0, F.greatest(F.lit(0.0), (a1 - a0 + b1 - b0) / F.when(span > 0, span) - 1)).otherwise(0.0)


def overlap_edges(nodes: DataFrame, width: int, least: float) -> DataFrame:
    """a < b, w for intervals (node, file, start, end) of one file that overlap by `least` or more.

    An equi-join on bins of `width`; a pair counts in the first bin that both reach, so it appears once."""
    bins = nodes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    x, y = bins.alias("x"), bins.alias("y")
    first = F.floor(F.greatest("x.start", "y.start") / width)
    both = x.join(y, (F.col("x.file") == F.col("y.file")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.node") < F.col("y.node"))).where(F.col("x.bin") == first)
    w = overlap(F.col("x.start"), F.col("x.end"), F.col("y.start"), F.col("y.end"))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), w.alias("w")).where(F.col("w") >= least)


@lru_cache
def own_folder(application: str) -> str:
    """A folder for an application on this machine (Spark doesn't let a running session set spark.checkpoint.dir)."""
    return tempfile.mkdtemp(prefix="framewright-")


def shared_folder(spark: SparkSession) -> str:
    """The application's part of the folder that the cluster names in spark.checkpoint.dir; a fresh one where that is unset and all runs on this machine (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = own_folder(spark.sparkContext.applicationId)
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node).  Labels fall along edges and then jump to their label's label, so rounds grow with the logarithm of the longest path; each round is written, so lineage stays short."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = written(nodes.select("node", F.col("node").alias("component")))
    while True:
        low = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("low"))
        step = label.join(low, label["node"] == low["a"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("c"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("up"))
        new = written(step.join(jump, "c").select("node", "old", F.least("c", "up").alias("component")))
        if not new.where("old <> component").limit(1).count():
            return new.select("node", "component")
        label = new.select("node", "component")


def strong_edges(edges: DataFrame, over: float, neighbours: int) -> DataFrame:
    """Edges (a, b, w) over a weight, at most `neighbours` for each a: those to its smallest nodes.  (The fast clustering's own rule.)"""
    rank = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    return edges.where(F.col("w") > over).withColumn("__k", rank).where(F.col("__k") <= neighbours).drop("__k")


def greedy_dedup(nodes: DataFrame, least: float, order: tuple[str, ...] = ("node",), width: float = 100.0) -> DataFrame:
    """Within each cluster, in the given order, an interval goes if it overlaps a kept earlier one of its file by `least`.

    The rule depends on order within (cluster, file): rows come sorted to the task that owns the group and pass through
    in batches; only the group's kept intervals are held, by the stretches of `width` that they reach, so an interval meets
    those near it and no others."""

    def reached(a: float, b: float) -> range:
        # Below 0 any two intervals would count as overlapping: one stretch for all.
        return range(1) if least < 0 else range(int(a // width), int(b // width) + 1)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, {}
        for batch in batches:
            take = []
            for cluster, file, a, b in zip(batch["cluster"].tolist(), batch["file"].tolist(), batch["start"].tolist(), batch["end"].tolist(), strict=True):
                if now != (cluster, file):
                    now, kept = (cluster, file), {}
                near = {x for s in reached(a, b) for x in kept.get(s, ())}
                fresh = all((span := max(b, d) - min(a, c)) <= 0 or (b - a + d - c) / span - 1 < least for c, d in near)
                take.append(fresh)
                if fresh:
                    for s in reached(a, b):
                        kept.setdefault(s, []).append((a, b))
            yield batch[take]

    columns = ["cluster", "file", "node", "start", "end"]
    rows = nodes.select(*columns).repartition("cluster", "file").sortWithinPartitions("cluster", "file", *order)
    return rows.mapInPandas(keep, rows.schema)


def bags(terms: DataFrame) -> DataFrame:
    """doc, term, cnt."""
    return terms.groupBy("doc", "term").agg(F.count("*").alias("cnt"))


def svmlight(counts: DataFrame) -> DataFrame:
    """doc and a line `doc term:count ...`, terms in order."""
    pairs = F.sort_array(F.collect_list(F.struct("term", "cnt")))
    return counts.groupBy("doc").agg(pairs.alias("p")).select("doc", F.concat_ws(" ", F.col("doc").cast("string"), F.array_join(F.transform("p", lambda x: F.concat(x["term"].cast("string"), F.lit(":"), x["cnt"].cast("string"))), " ")).alias("line"))


def largest(clusters: DataFrame, n: int, members: int) -> DataFrame:
    """cluster, size, node: a report of the n largest clusters with up to `members` nodes each, drawn by hash."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(n)
    w = Window.partitionBy("cluster").orderBy(F.md5(F.col("node").cast("string")), "node")
    rows = clusters.join(F.broadcast(sizes), "cluster")  # n rows
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= members).select("cluster", "size", "node")
