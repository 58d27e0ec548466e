"""Request defaults, unions, view regions, maps, display images, frame files and shards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions import optics
from lumenloom.functions.numeric import lit
from lumenloom.operators import fields
from lumenloom.plans import views
from lumenloom.plans.catalog import R, query, r6
from lumenloom.plans.light import APERTURE, COMPLEX
from lumenloom.plans.views import table, with_views
from lumenloom.sources import points, shards


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 3 = 0 THEN 5e0 END, 1e0) AS separation,
    CASE WHEN o_orderkey % 4 = 1 THEN 'KEEP' WHEN o_orderkey % 5 = 0 THEN 'PARK_AND_RELEASE' ELSE 'KEEP' END AS policy FROM orders""")
def prj_01_request_defaults(spark, sf_dir):
    """A request's value, else the compiler's, else the default; parking sites without a policy imply that
    extra atoms are parked and released."""
    key = F.col("o_orderkey")
    asked, configured = F.when(key % 2 == 0, F.col("o_totalprice")), F.when(key % 3 == 0, lit(5))
    policy, has_parking = F.when(key % 4 == 1, "KEEP"), key % 5 == 0
    return table(spark, sf_dir, "orders").select(key, F.coalesce(asked, configured, lit(1)).alias("separation"), F.coalesce(policy, F.when(has_parking, "PARK_AND_RELEASE"), F.lit("KEEP")).alias("policy"))


@query(with_views("atoms", "points") + " SELECT 'atom' AS kind, atom_id AS id, " + R("x") + " AS x, " + R("y") + " AS y FROM atoms WHERE NOT movable UNION ALL SELECT 'trap', point_id, " + R("x") + ", " + R("y") + " FROM points WHERE point_id % 50 = 7")
def set_01_static_points(spark, sf_dir):
    """All static points: fixed atoms and occupied static traps."""
    a = views.atoms(spark, sf_dir).where("not movable").select(F.lit("atom").alias("kind"), F.col("atom_id").alias("id"), "x", "y")
    t = views.points(spark, sf_dir).where("point_id % 50 = 7").select(F.lit("trap").alias("kind"), F.col("point_id").alias("id"), "x", "y")
    return a.unionByName(t).select("kind", "id", r6("x").alias("x"), r6("y").alias("y"))


@query(with_views("points") + " SELECT DISTINCT floor(x * 1e9 + 5e-1) / 1e9 AS coordinate FROM points")
def set_04_coordinates(spark, sf_dir):
    """The different coordinates of a grid, to nine digits."""
    return views.points(spark, sf_dir).select((F.floor(F.col("x") * lit(1e9) + lit(0.5)) / lit(1e9)).alias("coordinate")).distinct()


@query(with_views("frames") + " SELECT frame, trap_id, CAST(row_number() OVER (PARTITION BY frame ORDER BY trap_id) AS INTEGER) AS place FROM frames")
def srt_08_trap_order(spark, sf_dir):
    """The place of each trap in its frame."""
    return views.trap_frames(spark, sf_dir).select("frame", "trap_id", F.row_number().over(W.partitionBy("frame").orderBy("trap_id")).alias("place"))


@query(with_views("atoms") + ", b AS (SELECT grp, min(x) - 2e0 AS x0, max(x) + 2e0 AS x1, min(y) - 2e0 AS y0, max(y) + 2e0 AS y1 FROM atoms GROUP BY grp), s AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM b), g AS (SELECT *, CASE WHEN w < 15e-1 * h THEN 15e-1 * h ELSE w END AS w2, CASE WHEN w > 3e0 * h THEN w / 3e0 ELSE h END AS h2 FROM s) SELECT grp, " + R("(x0 + x1) / 2e0 - w2 / 2e0") + " AS x, " + R("(y0 + y1) / 2e0 - h2 / 2e0") + " AS y, " + R("w2") + " AS width, " + R("h2") + " AS height, " + R("w2 / h2") + " AS aspect FROM g")
def sca_57_view_regions(spark, sf_dir):
    """The padded bounds of each group, the short axis grown until the aspect lies between 1.5 and 3."""
    b = views.atoms(spark, sf_dir).groupBy("grp").agg((F.min("x") - 2).alias("x0"), (F.max("x") + 2).alias("x1"), (F.min("y") - 2).alias("y0"), (F.max("y") + 2).alias("y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    w2, h2 = F.greatest(w, lit(1.5) * h), F.greatest(h, w / lit(3))
    return b.select("grp", r6((F.col("x0") + F.col("x1")) / lit(2) - w2 / lit(2)).alias("x"), r6((F.col("y0") + F.col("y1")) / lit(2) - h2 / lit(2)).alias("y"), r6(w2).alias("width"), r6(h2).alias("height"), r6(w2 / h2).alias("aspect"))


@query("WITH g AS (SELECT CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x FROM (SELECT unnest(range(0, 64)) AS i)) SELECT p_partkey, y, x, " + R("exp(-4e0 * ((x - 35e-1) ** 2 + (y - 35e-1) ** 2) / (p_size * CAST(p_size AS DOUBLE)))") + " AS amplitude, " + R("(400e0 + p_size) * 1e-3 * 100e0 * 1e3 / (8e0 * 125e-1)") + " AS um_per_bin FROM part, g")
def num_35_incident_maps(spark, sf_dir):
    """The incident amplitude of every pixel of a calibration, and the plane's step of one frequency."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("d"), grid)
    y, x = F.floor(F.col("i") / 8).cast("int"), (F.col("i") % 8).cast("int")
    r2 = (x - lit(3.5)) * (x - lit(3.5)) + (y - lit(3.5)) * (y - lit(3.5))
    return p.select("p_partkey", y.alias("y"), x.alias("x"), r6(optics.gaussian_amplitude(r2, F.col("d"))).alias("amplitude"), r6(optics.first_null((lit(400) + F.col("d")) * lit(1e-3), lit(1e5), lit(8), lit(12.5))).alias("um_per_bin"))


@query(with_views("fields") + APERTURE + COMPLEX + ", v AS (SELECT field_id, py, px, floor(power / max(power) OVER (PARTITION BY field_id) * 1e6 + 5e-1) / 1e6 AS i FROM pw) SELECT field_id, py, px, CAST(floor(255e0 * i + 5e-1) AS INTEGER) AS linear, CAST(floor(255e0 * greatest(0e0, least(1e0, 1e0 + 1e1 * log10(greatest(i, 1e-6)) / 6e1)) + 5e-1) AS INTEGER) AS decibel FROM v")
def snk_13_display_images(spark, sf_dir):
    """Intensities as 8-bit images, linear and over 60 dB."""
    power = fields.over_peak(fields.shifted(fields.transform(fields.spatial(views.fields(spark, sf_dir)))))
    v = power.select("field_id", F.col("py").cast("int").alias("py"), F.col("px").cast("int").alias("px"), r6("intensity").alias("i"))
    db = F.greatest(lit(0), F.least(lit(1), lit(1) + lit(10) * F.log10(F.greatest("i", lit(1e-6))) / lit(60)))
    return v.select("field_id", "py", "px", F.floor(lit(255) * F.col("i") + lit(0.5)).cast("int").alias("linear"), F.floor(lit(255) * db + lit(0.5)).cast("int").alias("decibel"))


HEX = "array_to_string(list_transform(embedding, lambda v: printf('%02x', CAST(floor(least(greatest(CAST(v AS DOUBLE), -1e0), 1e0) * 127e0 + 128e0) AS BIGINT))), '')"


@query(f"SELECT vec_id // 10 AS file, CAST(64 * count(*) AS BIGINT) AS bytes, sha256(unhex(string_agg({HEX}, '' ORDER BY vec_id))) AS digest FROM embeddings GROUP BY 1")
def snk_04_frame_files(spark, sf_dir):
    """The frames of each sequence of ten as one file, in order."""
    code = lambda v: F.lpad(F.hex(F.floor(F.least(F.greatest(v.cast("double"), lit(-1)), lit(1)) * lit(127) + lit(128)).cast("long")), 2, "0")
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 10).cast("long").alias("file"), F.struct("vec_id", F.array_join(F.transform("embedding", code), "").alias("hex")).alias("f"))
    whole = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["hex"]), ""))
    return rows.groupBy("file").agg(whole.alias("content")).select("file", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query("WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings) SELECT CAST(k // 64 AS BIGINT) AS shard, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) = 64 AS full_shard, sha256(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id)) AS digest FROM s GROUP BY 1")
def snk_18_shards(spark, sf_dir):
    """Samples in order, cut into shards of 64; the manifest that closes each shard."""
    return shards.manifest(table(spark, sf_dir, "embeddings"), "vec_id", 64)


@query("WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_id AS key, CAST(0 AS BIGINT) AS frame, CAST(0 AS BIGINT) AS time, CAST(1 AS BIGINT) AS trap_id, CAST(NULL AS BIGINT) AS atom_id, k AS x, 25e-2 AS phase, 0 AS flags FROM e UNION ALL SELECT event_id, 0, 0, 2, NULL, 1e0, k, 0 FROM e")
def src_13_single_frames(spark, sf_dir):
    """A list of tweezers as one frame at time 0 without atoms."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit("["), F.lit("["), k, F.lit(", 3, 0.25], [1, 2, "), k, F.lit("]]"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), text.alias("text"))
    return points.single_frame(points.tweezers(rows, "key", "text"), "key").select("key", "frame", "time", "trap_id", "atom_id", "x", "phase", "flags")
