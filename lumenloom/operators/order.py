"""Global numbering without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.operators.lineage import cut


def _begins(ranged: DataFrame, amount: Column) -> DataFrame:
    """(_part, _base): what stands before each range; one number for a range reaches the driver."""
    begins, total = [], 0
    for r in ranged.groupBy("_part").agg(amount.alias("n")).orderBy("_part").collect():
        begins.append((r["_part"], total))
        total += r["n"] or 0
    return F.broadcast(ranged.sparkSession.createDataFrame(begins, "_part int, _base long"))


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """Adds the 0-based place of each row in a total order.

    Rows are sorted by ranges and written once; the sizes of the ranges, one number each, give the
    place at which each range begins.
    """
    ranged = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    return ranged.join(_begins(ranged, F.count("*")), "_part").withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def running(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of a whole-number column over all rows before each in a total order, ranges as in
    `numbered`: a window sees one range only."""
    ranged = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(_begins(ranged, F.sum(value)), "_part").withColumn(name, (inside + F.col("_base")).cast("long")).drop("_part", "_base")


def previous(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the value of the row before in the order of a unique key, null for the first: rows meet by
    their places, no window sees all of them."""
    placed = numbered(df, [key], "_place")
    before = placed.select((F.col("_place") + 1).alias("_place"), F.col(value).alias(name))
    return placed.join(before, "_place", "left").drop("_place")
