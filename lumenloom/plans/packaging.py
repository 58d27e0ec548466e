"""Committed samples, packages of tables, checks of complete sequences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit
from lumenloom.operators import sequences
from lumenloom.operators.lineage import shared
from lumenloom.plans import views
from lumenloom.plans.catalog import R, query, r6
from lumenloom.plans.views import table, with_views
from lumenloom.sources import commits, frame_files, packages


@query("SELECT CAST(vec_id % 3 AS BIGINT) AS commit, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id, 'ok' AS status FROM embeddings GROUP BY 1")
def stm_09_committed_samples(spark, sf_dir):
    """All vectors as samples in three commits; one is sent again whole, and one holds what another has."""
    path, rows = shared(spark), table(spark, sf_dir, "embeddings")
    batch = lambda k: rows.where(F.col("vec_id") % 3 == k)
    for commit, sent in ((0, batch(0)), (1, batch(1)), (1, batch(1)), (2, rows.where("vec_id % 3 != 1"))):
        commits.append(sent, commit, path, "vec_id")
    return commits.verified(spark, path, "vec_id")


@query(with_views("atoms", "targets", "waypoints", "ways", "frames") + " " + " UNION ALL ".join(f"SELECT '{member}' AS member, count(*) AS rows, 0 AS damaged FROM {view}" for member, view in (("atoms", "atoms"), ("sites", "targets"), ("trajectories", "ways"), ("frames", "frames"))))
def snk_01_package(spark, sf_dir):
    """Atoms, sites, trajectories and frames as one package: the rows of each by the manifest, and how
    many of its files aren't as written."""
    path = shared(spark)
    parts = {"atoms": views.atoms(spark, sf_dir), "sites": views.targets(spark, sf_dir), "trajectories": views.ways(spark, sf_dir), "frames": views.trap_frames(spark, sf_dir)}
    listed = packages.write(parts, path)
    damaged = packages.verified(spark, path).groupBy("member").agg(F.sum((F.col("status") != "ok").cast("int")).alias("damaged"))
    return packages.summary(listed).join(damaged, "member").select("member", "rows", F.col("damaged").cast("int").alias("damaged"))


@query(
    with_views("waypoints", "ways", "frames")
    + """, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trajectory ORDER BY seq DESC) AS r FROM ways) WHERE r = 1),
    a AS (SELECT trajectory AS atom_id, CASE WHEN trajectory % 11 = 0 THEN NULL WHEN trajectory % 13 = 0 THEN trajectory + 1 ELSE trajectory END AS site_id FROM e),
    t AS (SELECT trajectory AS site_id, x + CASE trajectory % 7 WHEN 3 THEN 1e0 ELSE 0e0 END AS x, y, trajectory % 2 = 0 AS required, CASE trajectory % 3 WHEN 0 THEN NULL ELSE 1e0 END AS wanted FROM e),
    f AS (SELECT frame, trap_id, intensity FROM frames WHERE trap_id % 17 <> 0 UNION ALL SELECT (SELECT max(frame) + 1 FROM frames), trajectory, CASE trajectory % 5 WHEN 1 THEN 2e0 ELSE 1e0 END FROM e),
    m AS (SELECT frame, count(*) AS n, max(trap_id) AS top FROM frames GROUP BY 1),
    i AS (SELECT 'error' AS level, 'ASSIGNMENT_INFEASIBLE' AS code, CAST(NULL AS BIGINT) AS atom_id, site_id, CAST(NULL AS BIGINT) AS frame, CAST(n AS DOUBLE) AS measured FROM (SELECT coalesce(t.site_id, c.site_id) AS site_id, coalesce(c.n, 0) AS n, required FROM t FULL JOIN (SELECT site_id, count(*) AS n FROM a WHERE site_id IS NOT NULL GROUP BY 1) c ON c.site_id = t.site_id) WHERE n > 1 OR required AND n = 0
    UNION ALL SELECT 'error', 'FINAL_POSITION_MISMATCH', atom_id, site_id, NULL, sqrt((e.x - t.x) ** 2 + (e.y - t.y) ** 2) FROM a JOIN t USING (site_id) JOIN e ON e.trajectory = a.atom_id WHERE sqrt((e.x - t.x) ** 2 + (e.y - t.y) ** 2) > 1e-3
    UNION ALL SELECT 'error', 'ILLEGAL_LIFECYCLE', atom_id, site_id, NULL, CASE atom_id % 5 WHEN 1 THEN 2e0 ELSE 1e0 END FROM a JOIN t USING (site_id) WHERE atom_id % 5 = 1 OR atom_id % 19 = 0
    UNION ALL SELECT CASE WHEN n % 4 = 0 THEN 'error' ELSE 'warning' END, CASE WHEN n % 4 = 0 THEN 'FRAME_QUALITY_REJECTED' ELSE 'WGS_NOT_CONVERGED' END, NULL, NULL, frame, NULL FROM m WHERE n % 4 = 0 OR top % 2 = 1
    UNION ALL SELECT 'error', 'FRAME_COUNT_MISMATCH', NULL, NULL, frame, CAST(greatest(x, y, z) AS DOUBLE) FROM (SELECT frame, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM (SELECT DISTINCT frame, 1 AS x, 0 AS y, 0 AS z FROM f UNION ALL SELECT frame, 0, CASE WHEN n % 10 = 9 THEN 2 ELSE 1 END, 1 FROM m) GROUP BY 1) WHERE x <> 1 OR y <> 1 OR z <> 1)
    SELECT level, code, atom_id, site_id, frame, """
    + R("measured")
    + " AS measured FROM i"
)
def ext_07_sequence_issues(spark, sf_dir):
    """All that is wrong with the sequence of all ways but their clearance, which has a query of its own."""
    way, frames = views.ways(spark, sf_dir), views.trap_frames(spark, sf_dir)
    end = way.withColumn("r", F.row_number().over(W.partitionBy("trajectory").orderBy(F.desc("seq")))).where("r = 1")
    k = F.col("trajectory")
    assigned = end.select(k.alias("atom_id"), F.when(k % 11 == 0, None).when(k % 13 == 0, k + 1).otherwise(k).alias("site_id"))
    sites = end.select(k.alias("site_id"), (F.col("x") + F.when(k % 7 == 3, lit(1)).otherwise(lit(0))).alias("x"), "y", (k % 2 == 0).alias("required"), F.when(k % 3 != 0, lit(1)).alias("final_intensity"))
    after = frames.agg((F.max("frame") + 1).alias("frame"))
    final = end.crossJoin(F.broadcast(after)).select("frame", k.alias("trap_id"), F.when(k % 19 != 0, k).alias("atom_id"), F.when(k % 5 == 1, lit(2)).otherwise(lit(1)).alias("intensity"))
    shown = frames.where("trap_id % 17 != 0").select("frame", "trap_id", F.col("trap_id").alias("atom_id"), "intensity").unionByName(final)
    counted = frames.groupBy("frame").agg(F.count("*").alias("n"), F.max("trap_id").alias("top"))
    described = counted.select("frame", F.explode(F.sequence(F.lit(1), F.when(F.col("n") % 10 == 9, 2).otherwise(1))))
    metrics = counted.select("frame", F.lit(True).alias("valid"), (F.col("n") % 4 != 0).alias("accepted"), (F.col("top") % 2 == 0).alias("converged"))
    way = way.withColumn("trap_id", k)
    found = sequences.unassigned(assigned, sites).unionByName(sequences.misplaced(assigned, sites, way, 1e-3)).unionByName(sequences.released(assigned, sites, way, shown, 1.0))
    found = found.unionByName(sequences.rejected_frames(metrics)).unionByName(sequences.unmatched_frames(shown, described, metrics))
    return found.select("level", "code", "atom_id", "site_id", "frame", r6("measured").alias("measured"))


@query(with_views("frames") + " SELECT frame, CAST(frame * 21600 AS BIGINT) AS time, trap_id, CASE WHEN event_id % 4 <> 0 THEN event_id END AS atom_id, " + R("x") + " AS x, " + R("y") + " AS y, " + R("intensity") + " AS intensity, " + R("phase") + " AS phase, CAST(event_id % 8 AS BIGINT) AS flags FROM frames")
def src_10_frame_files(spark, sf_dir):
    """All frames written as files of packed frames and read again in parts."""
    path, seen = shared(spark), views.trap_frames(spark, sf_dir)
    e = F.col("event_id")
    frame_files.save(seen.select("frame", (F.col("frame") * 21600).alias("time"), "trap_id", F.when(e % 4 != 0, e).alias("atom_id"), "x", "y", "intensity", "phase", (e % 8).alias("flags")), path)
    found = frame_files.load(spark, path, 1 << 20)
    return found.select("frame", "time", "trap_id", "atom_id", *[r6(c).alias(c) for c in ("x", "y", "intensity", "phase")], "flags")
