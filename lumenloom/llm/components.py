"""Connected components of a link table by minimum labels with pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import materialize, meet


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member reachable from each of 0..n-1 over the links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if not ((label[a] != low) | (label[b] != low)).any():
            return label
        for end in (label[a], label[b], a, b):
            np.minimum.at(label, end, low)
        while (label != label[label]).any():
            label = label[label]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of at least one link.

    A round costs one join over the links and two over the labels, in which hubs and giant components
    are met by a broadcast of their few labels; every round is written to the shared folder; the number of rounds grows with the logarithm of the longest chain. Null
    ends and self links are ignored; no links give no rows.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node is not null and next is not null and node <> next")
    ends = materialize(ends.union(ends.select("next", "node")).distinct(), "links")
    labels = materialize(ends.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("component")), "labels")
    while True:
        other = labels.select(F.col("node").alias("next"), F.col("component").alias("seen"))
        lower = meet(ends, other, "next").groupBy("node").agg(F.min("seen").alias("seen"))
        stepped = materialize(labels.join(lower, "node").select("node", "component", F.least("component", "seen").alias("low")), "lowered")
        roots = stepped.groupBy("component").agg(F.min("low").alias("root_low"))
        stepped = materialize(meet(stepped, roots, "component").select("node", F.col("component").alias("was"), F.least("low", "root_low").alias("low")), "stepped")
        up = stepped.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
        labels = materialize(meet(stepped, up, "low").select("node", "was", F.col("lowest").alias("component")), "labels")
        if labels.where("was <> component").limit(1).count() == 0:
            return labels.select("node", "component")
        labels = labels.select("node", "component")
