"""Several tables written as one package, closed by a manifest of all their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"


def _files(spark: SparkSession, path: str, members: list[str]) -> DataFrame:
    """member, file, bytes, sha256 of every file of the members as it is now."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{path}/{m}" for m in members])
    at = F.split("path", "/")
    return found.select(F.element_at(at, -2).alias("member"), F.element_at(at, -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write(members: dict[str, DataFrame], path: str, rows_a_file: int = 1_000_000) -> DataFrame:
    """Writes each table below path and, when all are there, the manifest: member, file, bytes, sha256,
    rows of every file. Until then the package can't be read. Hashes are taken where the files are read,
    file by file; rows_a_file bounds a file. Gives the manifest."""
    if not members or MANIFEST in members:
        raise ValueError(f"a package has members, and none of them is called {MANIFEST}")
    spark = next(iter(members.values())).sparkSession
    counts = None
    for name, df in members.items():
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/{name}")
        rows = spark.read.parquet(f"{path}/{name}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows")).withColumn("member", F.lit(name))
        counts = rows if counts is None else counts.unionByName(rows)
    listed = _files(spark, path, list(members)).join(counts, ["member", "file"], "left")
    listed.withColumn("rows", F.coalesce("rows", F.lit(0))).write.parquet(f"{path}/{MANIFEST}")
    return spark.read.parquet(f"{path}/{MANIFEST}")


def summary(manifest: DataFrame) -> DataFrame:
    """files, rows, bytes and one digest of each member. Digests are merged: a sum over the files of 60 bits
    of each one's hash, whatever their order."""
    part = F.conv(F.substring(F.sha2(F.concat_ws(":", "file", "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = manifest.groupBy("member").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum(part).alias("mixed"))
    return sums.select("member", "files", "rows", "bytes", F.sha2(F.concat_ws(":", "member", "files", "rows", "bytes", "mixed"), 256).alias("digest"))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """member, file, status of every file of a package: ok, changed, missing or unexpected."""
    listed = spark.read.parquet(f"{path}/{MANIFEST}").select("member", "file", "bytes", "sha256")
    members = [r[0] for r in listed.select("member").distinct().collect()]
    now = _files(spark, path, members).select("member", "file", F.col("bytes").alias("now_bytes"), F.col("sha256").alias("now"))
    status = F.when(F.col("sha256").isNull(), "unexpected").when(F.col("now").isNull(), "missing").when((F.col("sha256") == F.col("now")) & (F.col("bytes") == F.col("now_bytes")), "ok").otherwise("changed")
    return listed.join(now, ["member", "file"], "full").select("member", "file", status.alias("status"))


def read(spark: SparkSession, path: str, member: str) -> DataFrame:
    """A table of a package, once all its files are as the manifest has them; else an error names them."""
    bad = verified(spark, path).where((F.col("member") == member) & (F.col("status") != "ok")).limit(20).collect()
    if bad:
        raise ValueError(f"{member} is not as written: {[(r['file'], r['status']) for r in bad]}")
    return spark.read.parquet(f"{path}/{member}")
