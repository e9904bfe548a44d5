"""Tables as segments of frames: (seg_id, frame_no, features, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a segment, its lines are frames of four features; the label is the return flag (A, N, R: 0, 1, 2)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seg_id"), (F.row_number().over(order) - 1).alias("frame_no"),
        F.array(*[F.col(f"l_{c}").cast("double") for c in ("quantity", "extendedprice", "discount", "tax")]).alias("features"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"), "l_linestatus",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a category, a pseudo-speaker and a pseudo-file."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label", (F.col("vec_id") % 5).alias("speaker"), (F.col("vec_id") % 20).alias("file")
    )


def posteriors(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """Class probabilities: softmax of a vector's first n values; segment vec_id mod 50."""
    from framewright.functions.arrays import softmax

    return vectors(spark, sf_dir).select((F.col("vec_id") % 50).alias("seg_id"), "vec_id", "label", softmax(F.slice("features", 1, n)).alias("p"))
