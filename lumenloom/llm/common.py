"""What the operators of this subpackage share: reading tables, shared scratch tables, sampling."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A local run may do without a named one; on a
    cluster rows written to a machine's own disk would be lost, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lumenloom.shared.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lumenloom-')}"
        spark.conf.set("lumenloom.shared.dir", named)
    return named.rstrip("/")


#: Spark removes the shuffle files of a query at its end instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, keep_shuffle: bool = True) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it again: lineage ends here,
    and a lost executor costs no recomputation of what stands above. keep_shuffle=False: the files of
    its shuffles go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenloom-{uuid.uuid4().hex}/{label}"
    before = spark.conf.get(CLEANUP, "false")
    if not keep_shuffle:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if not keep_shuffle:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than this share of the rows, so there are fewer hot keys than its inverse.
HOT_SHARE, HOT_LEAST = 1e-4, 1 << 16


def meet(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows joined with named, which has one row for each key of rows. Hot keys, fewer than 1 / HOT_SHARE
    by definition, are broadcast, so that no task receives all rows of one of them. rows: a written table."""
    sizes = rows.groupBy(key).count().where(F.col("count") > HOT_LEAST)
    if not sizes.limit(1).count():
        return rows.join(named, key)
    hot = materialize(sizes.where(F.col("count") > F.lit(rows.count() * HOT_SHARE)).select(key), "hot")
    known = named.join(F.broadcast(hot), key, "left_semi")
    often, seldom = rows.join(F.broadcast(known), key), rows.join(F.broadcast(hot), key, "left_anti")
    return often.unionByName(seldom.join(named, key))


def give_back() -> None:
    """In a Python worker: large arrays go back to the system when freed, instead of growing a heap
    that the worker keeps over all its tasks."""
    import ctypes

    import pyarrow as pa

    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which would otherwise rise with use
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out from every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


#: Candidates looked at for each row that a class may give, so that long texts can be passed over.
SPARE = 4


def bounded_sample(docs: DataFrame, labels: DataFrame | None, *, doc_id: str, text: str, label: str, per_class: int, max_bytes: int, seed: int):
    """At most per_class rows of each label in a fixed hash order, within max_bytes of text.

    Each class may use its equal part of max_bytes; a text above what is left of it is passed over for
    one of the next rows (SPARE times per_class are looked at). A class none of whose candidates fits
    gives the shortest of them, so that no class is missing. No class is left out, however many there are.

    labels: one row for each doc_id; None: the label is a column of docs. Rows that repeat a doc_id
    count once, with the least text. Keys, labels and lengths are read once and written; a bound on
    the hash leaves a number of them for each class that doesn't grow with the corpus; texts are fetched
    for the chosen keys alone. Returns a pandas frame (key, label, text): all that a fit on the driver sees.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).alias("size")
    sizes = docs.select(F.col(f"`{doc_id}`").alias("key"), size, *([F.col(f"`{label}`").cast("string").alias("label")] if labels is None else [])).where("key is not null")
    if labels is not None:
        sizes = sizes.join(labels.select(F.col(doc_id).alias("key"), F.col(label).cast("string").alias("label")), "key")
    sizes = materialize(sizes.where("label is not null").withColumn("hash", F.xxhash64(F.col("key").cast("string"), F.lit(seed))), "sizes")
    # Of a large class only the rows below a hash bound, some twice as many as needed, reach the window.
    share = F.least(F.lit(1.0), F.lit(2.0 * SPARE * per_class + 100) / F.col("count"))
    near = sizes.join(sizes.groupBy("label").count(), "label").where(F.col("hash") / F.lit(2.0**64) + F.lit(0.5) <= share)
    order = W.partitionBy("label").orderBy("hash", "key", F.desc("size"))
    first = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SPARE * per_class)
    ranked = first.groupBy("label", "key").agg(F.min("at").alias("at"), F.max("size").alias("size")).orderBy("label", "at").collect()
    by_class: dict[str, list] = {}
    for r in ranked:
        by_class.setdefault(r["label"], []).append(r)
    chosen = []
    for name, rows in by_class.items():
        budget, taken = max_bytes // len(by_class), []
        for r in rows:
            if r["size"] <= budget and len(taken) < per_class:
                taken.append((r["key"], name))
                budget -= r["size"]
        chosen += taken or [(min(rows, key=lambda r: (r["size"], r["at"]))["key"], name)]
    picked = spark.createDataFrame(chosen, "key long, label string")
    texts = docs.select(F.col(f"`{doc_id}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "key")
    once = texts.groupBy("key", "label").agg(F.min("text").alias("text"))
    return once.toPandas().sort_values(["key", "label"], kind="stable").reset_index(drop=True)
