"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; only a local run may do without a named folder,
    as a machine's own disk is not seen by the others."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lumenloom.shared.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lumenloom-')}"
        spark.conf.set("lumenloom.shared.dir", named)
    return f"{named.rstrip('/')}/lumenloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read again."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
