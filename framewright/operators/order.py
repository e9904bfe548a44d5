"""Places in a total order and pairs within groups, without a whole order or a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.graph import written


def sums_before(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of `value` over the rows before each in `order`, separately for each value of `by`; by ranges, as `places` has them."""
    dealt = written(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range", *by).agg(F.sum(value).alias("__n"))  # a row for each range and value of `by` in it
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__n")).drop("__n")
    own = F.sum(value).over(Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return dealt.withColumn("__own", own).join(before, ["__range", *by]).withColumn(out, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def places(df: DataFrame, by: list[str], order: list[str], out: str = "place") -> DataFrame:
    """df with its rows' places 0, 1, ... in `order`, separately for each value of `by`.

    Rows are dealt to ranges of (by, order), which split any value that many rows share as long as `order` tells the
    rows apart; each range is numbered by itself and begins where the counts of the ranges before it end.  The ranges
    are written, so the counts and the numbering see the same ones."""
    dealt = written(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range", *by).agg(F.count("*").alias("__n"))  # a row for each range and value of `by` in it
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(before, ["__range", *by]).withColumn(out, (F.col("__before") + F.col("__own")).cast("long")).drop("__range", "__own", "__before")


def paired(rows: DataFrame, by: list[str], key: str, width: int = 1_000) -> DataFrame:
    """by, a, b: every pair of rows of one group with a's key below b's, as structs; the pairs are the result, a group's square by definition.

    A group is dealt to blocks of about `width` rows by a hash of the key, and two blocks meet in a cell of their own: a task
    sees some cells of two blocks each, however large a group is.  Rows travel once for each block of their group."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / width).cast("int").alias("__blocks"))
    own = rows.join(sizes, by).withColumn("__own", F.pmod(F.xxhash64(key), F.col("__blocks")).cast("int"))
    value = F.struct(*[c for c in rows.columns if c not in by])
    x = own.select(*by, value.alias("x"), F.col("__own").alias("__i"), F.explode(F.sequence("__own", F.col("__blocks") - 1)).alias("__j"))
    y = own.select(*by, value.alias("y"), F.col("__own").alias("__j"), F.explode(F.sequence(F.lit(0), "__own")).alias("__i"))
    met = x.join(y, [*by, "__i", "__j"]).where((F.col("__i") < F.col("__j")) & (F.col(f"x.{key}") != F.col(f"y.{key}")) | (F.col(f"x.{key}") < F.col(f"y.{key}")))
    first = F.col(f"x.{key}") < F.col(f"y.{key}")
    return met.select(*by, F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
