"""Samples that a stream writes exactly once: batches in folders, published by a log of commits.

A store has the folders staging (what is being written), samples (one folder for each batch) and
log (one JSON line for each commit). A batch is written to staging, moved to samples and then logged;
readers see what is logged. A crash leaves a staged folder, which is deleted, or a moved one without
its line, which is complete and is adopted. One stream writes a store at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

ENTRY = "commit long, n long, first_id long, last_id long, digest string, stream string"
FOLDER = re.compile(r"commit=(\d+)")


class _Files:
    """The file system of a store, whichever Hadoop one its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.root, self._path = path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        where = self.at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def move(self, old: str, new: str) -> None:
        self._fs.mkdirs(self.at(new).getParent())
        if self._fs.exists(self.at(new)) or not self._fs.rename(self.at(old), self.at(new)):
            raise ValueError(f"{new} can't be published: it exists, or the move failed")

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def write(self, name: str, text: str) -> None:
        """The whole file or none: it is moved to its name when written."""
        folder, last = name.rsplit("/", 1)
        hidden = f"{folder}/.{last}.tmp"
        out = self._fs.create(self.at(hidden), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(hidden, name)


def _facts(samples: DataFrame, key: str) -> list:
    """n, first_id, last_id and a digest of all rows that doesn't depend on their order: sums of hashes,
    merged from the partitions."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(samples.columns)]).cast("decimal(38,0)")
    digest = F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(row), F.lit(0)).cast("string"))
    return [F.count("*").alias("n"), F.min(key).cast("long").alias("first_id"), F.max(key).cast("long").alias("last_id"), digest.alias("digest")]


def log(spark: SparkSession, path: str) -> DataFrame:
    """commit, n, first_id, last_id, digest, stream of each commit."""
    lines = [n for n in _Files(spark, path).names("log") if n.endswith(".json")]
    return spark.read.schema(ENTRY).json(f"{path}/log") if lines else spark.createDataFrame([], ENTRY)


def _logged(files: _Files) -> set[int]:
    return {int(n.removesuffix(".json")) for n in files.names("log") if n.endswith(".json")}


def _publish(spark: SparkSession, files: _Files, commit: int, key: str, stream: str) -> None:
    """Logs a moved batch by what its files hold."""
    rows = spark.read.parquet(f"{files.root}/samples/commit={commit}")
    facts = rows.agg(*_facts(rows, key)).first()
    files.write(f"log/{commit}.json", json.dumps({"commit": commit, **facts.asDict(), "stream": stream}) + "\n")


def recover(spark: SparkSession, path: str, key: str, stream: str = "") -> list[int]:
    """Puts a store right after a crash and gives the batches it adopted: staged ones are deleted, moved
    ones are logged. A folder of another name, or a commit without its folder, is an error."""
    files = _Files(spark, path)
    for name in files.names("staging"):
        files.delete(f"staging/{name}")
    for name in files.names("log"):
        if name.endswith(".tmp"):
            files.delete(f"log/{name}")
    folders = files.names("samples")
    if unknown := [n for n in folders if not FOLDER.fullmatch(n)]:
        raise ValueError(f"unexpected folders in samples: {unknown}")
    there, logged = {int(FOLDER.fullmatch(n)[1]) for n in folders}, _logged(files)
    if lost := sorted(logged - there):
        raise ValueError(f"commits without their samples: {lost}")
    for commit in sorted(there - logged):
        _publish(spark, files, commit, key, stream)
    return sorted(there - logged)


def append(samples: DataFrame, commit: int, path: str, key: str, stream: str = "", reached: Callable[[str], None] = lambda step: None) -> None:
    """Adds one batch, to be called by foreachBatch; a batch that is already there changes nothing.

    Of samples with one key the first to be committed stays (within a batch any one of them); samples
    without a key can't be told apart and all stay. Only commits whose keys overlap the batch's are read
    to find repeats. A commit of another stream's name with this number is an error, as it can't be a
    replay. reached is told each step and may raise, as tests of crashes do.
    """
    spark = samples.sparkSession
    files = _Files(spark, path)
    recover(spark, path, key, stream)
    if commit in _logged(files):
        if (by := log(spark, path).where(F.col("commit") == commit).first()["stream"]) != stream:
            raise ValueError(f"batch {commit} was committed by stream {by!r}, not {stream!r}")
        return
    samples = samples.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        span = samples.agg(F.min(key).cast("long").alias("low"), F.max(key).cast("long").alias("high")).first()
        fresh = samples.where(F.col(key).isNotNull()).dropDuplicates([key])
        if span["low"] is not None:
            overlap = [r["commit"] for r in log(spark, path).where((F.col("first_id") <= span["high"]) & (F.col("last_id") >= span["low"])).select("commit").collect()]
            if overlap:
                known = spark.read.parquet(*[f"{path}/samples/commit={c}" for c in overlap]).select(key)
                fresh = fresh.join(known, key, "left_anti").select(*samples.columns)
        fresh.unionByName(samples.where(F.col(key).isNull())).write.mode("overwrite").parquet(f"{path}/staging/commit={commit}")
    finally:
        samples.unpersist()
    reached("staged")
    files.move(f"staging/commit={commit}", f"samples/commit={commit}")
    reached("moved")
    _publish(spark, files, commit, key, stream)


def write_stream(samples: DataFrame, path: str, key: str, checkpoint: str, stream: str = "", reached: Callable[[str], None] = lambda step: None) -> DataStreamWriter:
    """A writer of a stream into a store; after a crash a new start with the same checkpoint goes on."""
    return samples.writeStream.foreachBatch(lambda batch, commit: append(batch, commit, path, key, stream, reached)).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All committed samples; what is staged or moved but not logged isn't seen."""
    commits = sorted(_logged(_Files(spark, path)))
    if not commits:
        raise ValueError(f"nothing is committed in {path}")
    return spark.read.parquet(*[f"{path}/samples/commit={c}" for c in commits])


def verified(spark: SparkSession, path: str, key: str) -> DataFrame:
    """commit, n, first_id, last_id, status of each batch: ok, changed (its rows aren't those logged),
    missing (logged, no rows there though it had some) or unexpected (there, not logged)."""
    files = _Files(spark, path)
    listed = log(spark, path)
    if not files.names("samples"):
        return listed.select("commit", "n", "first_id", "last_id", F.lit("missing").alias("status"))
    rows = spark.read.option("basePath", f"{path}/samples").parquet(f"{path}/samples")
    own = rows.drop("commit")
    now = rows.groupBy(F.col("commit").cast("long").alias("commit")).agg(*_facts(own, key)).withColumnsRenamed({c: f"now_{c}" for c in ("n", "first_id", "last_id", "digest")})
    status = F.when(F.col("digest").isNull(), "unexpected").when(F.col("now_digest").isNull() & (F.col("n") > 0), "missing").when(F.col("n") == 0, F.when(F.col("now_digest").isNull(), "ok").otherwise("changed")).when(F.col("digest") == F.col("now_digest"), "ok").otherwise("changed")
    both = listed.join(now, "commit", "full")
    return both.select("commit", F.coalesce("n", "now_n").alias("n"), F.coalesce("first_id", "now_first_id").alias("first_id"), F.coalesce("last_id", "now_last_id").alias("last_id"), status.alias("status"))
