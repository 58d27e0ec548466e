"""Domain tables derived from the given tables, for Spark and, as SQL, for DuckDB.

Only whole numbers, + - * /, floor and remainders are used, so that both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.floor(F.col(c) * lit(100) + lit(0.5)).cast("long")


def _lattice(df: DataFrame, key: str, money: str, columns: int) -> DataFrame:
    shift = F.pmod(_cents(money), F.lit(100)) / lit(200)
    return df.withColumn("x", lit(3) * (F.col(key) % columns) + shift).withColumn("y", lit(3) * F.floor(F.col(key) / columns) + shift)


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lattice(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", 32)
    return rows.select(F.col("s_suppkey").alias("atom_id"), "x", "y", F.col("s_nationkey").alias("grp"), (F.col("s_suppkey") % 10 != 9).alias("movable"), ((F.col("s_suppkey") % 7) * lit(0.01)).alias("sigma"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    most = table(spark, sf_dir, "supplier").agg(F.floor(F.count("*") * lit(0.5)).alias("most"))
    k = F.col("n_nationkey")
    return rows.crossJoin(F.broadcast(most)).where(k < F.col("most")).select(k.cast("long").alias("site_id"), (lit(3) * (k % 8) + lit(1.5)).alias("x"), (lit(3) * F.floor(k / 8) + lit(1.5)).alias("y"), (k % 5 != 4).alias("required"), F.col("n_regionkey").alias("grp"), (lit(0.5) + (k % 4) * lit(0.25)).alias("final_intensity"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lattice(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 256)
    return rows.select(F.col("c_custkey").alias("point_id"), "x", "y")


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as the way of one atom; 64 atoms share the plane of an instrument, and atoms
    of different instruments never meet."""
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trajectory"), F.floor(F.col("o_custkey") / 64).cast("long").alias("instrument"), F.row_number().over(order).alias("seq"), ((_cents("o_totalprice") % 1000) / lit(10)).alias("x"), ((F.col("o_orderkey") * 7919 % 1000) / lit(10)).alias("y")).withColumn("arrival", F.col("seq") * F.lit(1000).cast("long"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waypoints about a home for each customer: homes are 6 apart on a lattice of the one plane, and an
    atom moves within 10 of its home, so paths cross those of their neighbours whatever their ids."""
    key = F.col("trajectory")
    near = waypoints(spark, sf_dir).select("trajectory", "seq", (lit(6) * (key % 32) + F.col("x") / lit(10)).alias("x"), (lit(6) * F.floor(key / 32) + F.col("y") / lit(10)).alias("y"), "arrival")
    return near.withColumn("sigma", (key % 3) / lit(10)).withColumn("tick", F.col("seq") - 1)


def trap_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each frame of six hours and trap: that of the highest event."""
    frame = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(21600000000)).cast("long")
    best = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trap_id"), frame.alias("frame")).agg(F.max(F.struct("event_id", F.abs("value").alias("intensity"))).alias("e"))
    return best.select("frame", "trap_id", F.col("e.event_id").alias("event_id"), F.col("e.intensity").alias("intensity"), ((F.col("e.event_id") % 628) / lit(100) - lit(3)).alias("phase"), ((F.col("e.event_id") * 31 % 1000) / lit(10)).alias("x"), ((F.col("e.event_id") * 17 % 1000) / lit(10)).alias("y"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8 x 8 field of real values."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("field_id"), F.posexplode("embedding").alias("i", "v")).select("field_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("re"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by part and supplier modulo 64 as the grey levels of one image."""
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 64).cast("int").alias("py"), (F.col("l_partkey") % 64).cast("int").alias("px")).agg(F.count("*").alias("level"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by part and supplier as images, one for 64 suppliers each."""
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_suppkey") / 64).alias("image_id"), (F.col("l_suppkey") % 64).cast("int").alias("py"), (F.col("l_partkey") % 64).cast("int").alias("px")).agg(F.count("*").alias("level"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of 64 users each as a picture of 1272 x 1024 places: field_id, line, at, re."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 64).cast("long").alias("field_id"), (k * 17 % 1024).alias("line"), (k * 31 % 1272).alias("at"), (k % 7 + 1).alias("re"))


def json_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "props")


#: The same tables for DuckDB, to stand before a query.
SQL = {
    "atoms": """atoms AS (SELECT s_suppkey AS atom_id, 3e0 * (s_suppkey % 32) + j AS x, 3e0 * floor(s_suppkey / 32e0) + j AS y, s_nationkey AS grp, s_suppkey % 10 <> 9 AS movable, (s_suppkey % 7) * 1e-2 AS sigma
        FROM (SELECT *, ((CAST(floor(s_acctbal * 1e2 + 5e-1) AS BIGINT) % 100 + 100) % 100) / 2e2 AS j FROM supplier))""",
    "targets": """targets AS (SELECT CAST(n_nationkey AS BIGINT) AS site_id, 3e0 * (n_nationkey % 8) + 15e-1 AS x, 3e0 * floor(n_nationkey / 8e0) + 15e-1 AS y, n_nationkey % 5 <> 4 AS required, n_regionkey AS grp, 5e-1 + (n_nationkey % 4) * 25e-2 AS final_intensity
        FROM nation WHERE n_nationkey < (SELECT floor(count(*) * 5e-1) FROM supplier))""",
    "points": """points AS (SELECT c_custkey AS point_id, 3e0 * (c_custkey % 256) + j AS x, 3e0 * floor(c_custkey / 256e0) + j AS y
        FROM (SELECT *, ((CAST(floor(c_acctbal * 1e2 + 5e-1) AS BIGINT) % 100 + 100) % 100) / 2e2 AS j FROM customer))""",
    "waypoints": """waypoints AS (SELECT *, CAST(seq * 1000 AS BIGINT) AS arrival FROM (SELECT o_custkey AS trajectory, o_custkey // 64 AS instrument, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS seq, (CAST(floor(o_totalprice * 1e2 + 5e-1) AS BIGINT) % 1000) / 1e1 AS x, (o_orderkey * 7919 % 1000) / 1e1 AS y FROM orders))""",
    "ways": """ways AS (SELECT trajectory, seq, seq - 1 AS tick, (trajectory % 3) / 1e1 AS sigma, 6e0 * (trajectory % 32) + x / 1e1 AS x, 6e0 * floor(trajectory / 32e0) + y / 1e1 AS y, arrival FROM waypoints)""",
    "frames": """frames AS (SELECT frame, trap_id, event_id, intensity, (event_id % 628) / 1e2 - 3e0 AS phase, (event_id * 31 % 1000) / 1e1 AS x, (event_id * 17 % 1000) / 1e1 AS y FROM (
        SELECT user_id AS trap_id, CAST(floor(epoch_us(ts) / 216e8) AS BIGINT) AS frame, event_id, abs(value) AS intensity, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 216e8) ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)""",
    "fields": """fields AS (SELECT vec_id AS field_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS re FROM embeddings, (SELECT unnest(range(0, 64)) AS i))""",
    "raster": """raster AS (SELECT CAST(l_suppkey % 64 AS INTEGER) AS py, CAST(l_partkey % 64 AS INTEGER) AS px, count(*) AS level FROM lineitem GROUP BY 1, 2)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
