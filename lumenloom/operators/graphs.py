"""Connected components of links by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.operators.lineage import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of a link reaches. Each round is written; their
    number follows the logarithm of the longest chain. Rounds merge sorted sides: labels that are
    broadcast would pass through the driver anew in each."""
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node <> next")
    ends = cut(ends.union(ends.select("next", "node")).distinct())
    labels = cut(ends.groupBy("node").agg(F.least("node", F.min("next")).alias("component")))
    while True:
        seen = ends.join(labels.select(F.col("node").alias("next"), F.col("component").alias("seen")).hint("merge"), "next").groupBy("node").agg(F.min("seen").alias("seen"))
        low = labels.join(seen.hint("merge"), "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("root")).hint("merge")
        labels = cut(low.join(up, "low").select("node", "was", F.least("low", "root").alias("component")))
        if labels.where("was <> component").limit(1).count() == 0:
            return labels.select("node", "component")
        labels = labels.select("node", "component")
