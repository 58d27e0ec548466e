"""Samples in shards: numbered in order, written by shard, closed by a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.operators.order import numbered


def sharded(samples: DataFrame, key: str, size: int) -> DataFrame:
    """Adds the shard of each sample: `size` samples in the order of their ids."""
    return numbered(samples, [key], "_place").withColumn("shard", (F.col("_place") / size).cast("long")).drop("_place")


def manifest(samples: DataFrame, key: str, size: int) -> DataFrame:
    """Per shard: n, first_id, last_id, full_shard and the digest of its ids in order. A shard holds at
    most `size` ids, so its list is small."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda v: v.cast("string")), ",")
    found = sharded(samples.select(key), key, size).groupBy("shard").agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.sha2(ids.cast("binary"), 256).alias("digest"))
    return found.select("shard", "n", "first_id", "last_id", (F.col("n") == size).alias("full_shard"), "digest")


def write(samples: DataFrame, key: str, size: int, path: str) -> DataFrame:
    """Writes samples as Parquet, one folder a shard, and the manifest behind them, which says that the
    write is complete; gives the manifest."""
    placed = sharded(samples, key, size)
    placed.repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(f"{path}/samples")
    listed = manifest(samples, key, size)
    listed.write.parquet(f"{path}/manifest")
    return samples.sparkSession.read.parquet(f"{path}/manifest")


def missing(written: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted samples that are not written yet: where to go on after a stop."""
    return wanted.join(written.select(key).distinct(), key, "left_anti")
