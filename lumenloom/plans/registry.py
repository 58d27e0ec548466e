"""All registered queries of the engine with their DuckDB counterparts.

A query is named after the operators it covers. Further ones stand in the modules imported at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions import geometry, hashing, motion, numeric, optics
from lumenloom.functions.numeric import lit
from lumenloom.operators import auction, fields, frames, joins, order, rasters, validate
from lumenloom.plans import views
from lumenloom.plans.catalog import FLAGSHIP, ORACLES, QUERIES, R, WRAP, query, r6, r9  # noqa: F401
from lumenloom.sources import packed, points
from lumenloom.streaming import sequence
from lumenloom.plans.views import table, with_views

MATRIX = """, m AS (SELECT atom_id, site_id, CASE WHEN d2 <= 625e-4 THEN (d2 + p) * 1e-3 ELSE d2 + p END AS cost FROM (
    SELECT a.atom_id, t.site_id, (a.x - t.x) * (a.x - t.x) + (a.y - t.y) * (a.y - t.y) AS d2, CASE WHEN a.grp <> t.grp THEN 4e0 ELSE 0e0 END AS p
    FROM atoms a, targets t WHERE a.movable AND t.required))"""


# --- assignment -----------------------------------------------------------------------------


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.cost_matrix(views.atoms(spark, sf_dir), views.targets(spark, sf_dir))


@query(with_views("atoms", "targets") + MATRIX + f" SELECT atom_id, site_id, {R('cost')} AS cost FROM m")
def join_01_cost_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("atom_id", "site_id", r6("cost").alias("cost"))


@query(with_views("atoms", "targets") + MATRIX + f" SELECT site_id, atom_id, {R('cost')} AS cost FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY cost, atom_id) AS r FROM m) WHERE r = 1")
def join_01_cheapest_source(spark, sf_dir):
    best = joins.cheapest_nearby(views.atoms(spark, sf_dir), views.targets(spark, sf_dir))
    return best.select("site_id", "atom_id", r6("cost").alias("cost"))


@query(with_views("atoms", "targets") + MATRIX + f", b AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY cost, atom_id) AS r FROM m WHERE cost < 2e2) SELECT count(*) AS n_sites, count(DISTINCT atom_id) AS n_atoms, {R('sum(cost)')} AS total FROM b WHERE r = 1")
def agg_01_assignment_total(spark, sf_dir):
    best = joins.cheapest_source(_matrix(spark, sf_dir).where(F.col("cost") < lit(200)))
    return best.agg(F.count("*").alias("n_sites"), F.countDistinct("atom_id").alias("n_atoms"), r6(F.sum("cost")).alias("total"))


@query(with_views("atoms") + """, p AS (SELECT atom_id, row_number() OVER (ORDER BY atom_id) - 1 AS k FROM atoms WHERE NOT movable), e AS (SELECT min(x) AS x0, max(y) AS y1 FROM atoms)
    SELECT atom_id, floor((x0 + k * 24e-1) * 1e6 + 5e-1) / 1e6 AS x, floor((y1 + 24e-1) * 1e6 + 5e-1) / 1e6 AS y FROM p, e""")
def gen_03_parking_sites(spark, sf_dir):
    atoms = views.atoms(spark, sf_dir)
    edge = atoms.agg(F.min("x").alias("x0"), F.max("y").alias("y1"))
    placed = order.numbered(atoms.where("not movable").select("atom_id"), ["atom_id"], "k")
    return placed.crossJoin(F.broadcast(edge)).select("atom_id", r6(F.col("x0") + F.col("k") * lit(2.4)).alias("x"), r6(F.col("y1") + lit(2.4)).alias("y"))


# --- validation -----------------------------------------------------------------------------


@query(with_views("points") + """ SELECT 'OUT_OF_BOUNDS' AS code, point_id AS id FROM points WHERE NOT (x BETWEEN 3e0 AND 7e2 AND y BETWEEN 0e0 AND 15e1)
    UNION ALL SELECT 'INVALID_ARGUMENT', point_id FROM points WHERE NOT (point_id % 97 <> 5)""")
def prj_07_violations(spark, sf_dir):
    p = views.points(spark, sf_dir)
    inside = F.col("x").between(lit(3), lit(700)) & F.col("y").between(lit(0), lit(150))
    return validate.violations(p, "point_id", {"OUT_OF_BOUNDS": inside & validate.finite(F.col("x")), "INVALID_ARGUMENT": F.col("point_id") % 97 != 5})


@query("SELECT 'DUPLICATE_ID' AS code, user_id AS id FROM events GROUP BY user_id HAVING count(*) > 1")
def set_05_duplicate_ids(spark, sf_dir):
    return validate.duplicates(table(spark, sf_dir, "events"), "user_id").select("code", "id")


@query(with_views("atoms", "targets") + " SELECT required, available, available >= required AS accepted FROM (SELECT count(*) FILTER (WHERE required) AS required FROM targets), (SELECT count(*) FILTER (WHERE movable) AS available FROM atoms)")
def prj_06_enough_atoms(spark, sf_dir):
    return validate.enough(views.atoms(spark, sf_dir), views.targets(spark, sf_dir))


@query("""SELECT o_orderkey AS id, CASE WHEN k = 0 THEN n = 3 AND r >= 0 WHEN k = 1 THEN n = 4 AND a <= c ELSE n >= 6 AND n % 2 = 0 END AS ok
    FROM (SELECT o_orderkey, o_orderkey % 3 AS k, 3 + o_orderkey % 5 AS n, (o_orderkey % 11) - 2e0 AS r, (o_orderkey % 7) * 1e0 AS a, (o_orderkey % 11) - 2e0 AS c FROM orders)""")
def prj_05_region_shapes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    k = F.col("id") % 3
    kind = F.when(k == 0, "circle").when(k == 1, "box").otherwise("polygon")
    numbers = F.array((F.col("id") % 7).cast("double"), lit(0), (F.col("id") % 11).cast("double") - lit(2), lit(1), lit(5), lit(2), lit(9))
    return o.select("id", validate.region_shape_ok(kind, F.slice(numbers, F.lit(1), (F.col("id") % 5 + 3).cast("int"))).alias("ok"))


@query("""SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1""")
def agg_30_rejections(spark, sf_dir):
    reason = F.trim(F.substring_index("event_type", ":", 1))
    return table(spark, sf_dir, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


# --- separation -----------------------------------------------------------------------------


@query(with_views("points") + f" SELECT a.point_id AS a_id, b.point_id AS b_id, {R('sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))')} AS distance FROM points a JOIN points b ON a.point_id < b.point_id AND abs(a.x - b.x) < 28e-1 AND abs(a.y - b.y) < 28e-1 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 28e-1")
def join_04_near_pairs(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return joins.near_pairs(p, p, "point_id", "point_id", 2.8, same=True).select("a_id", "b_id", r6("distance").alias("distance"))


@query(with_views("atoms", "targets") + f" SELECT t.site_id AS a_id, a.atom_id AS b_id, {R('sqrt((a.x-t.x)*(a.x-t.x)+(a.y-t.y)*(a.y-t.y))')} AS distance FROM targets t, atoms a WHERE sqrt((a.x-t.x)*(a.x-t.x)+(a.y-t.y)*(a.y-t.y)) < 2e0")
def join_06_targets_near_traps(spark, sf_dir):
    near = joins.near_pairs(views.targets(spark, sf_dir), views.atoms(spark, sf_dir), "site_id", "atom_id", 2.0)
    return near.select("a_id", "b_id", r6("distance").alias("distance"))


@query(with_views("frames") + ", u AS (SELECT DISTINCT trap_id FROM frames), t AS (SELECT DISTINCT trap_id AS o FROM frames WHERE frame % 7 = 0), h AS (SELECT max(trap_id) AS top FROM u) SELECT trap_id AS key, trap_id FROM u WHERE trap_id NOT IN (SELECT o FROM t) UNION ALL SELECT trap_id, top + row_number() OVER (ORDER BY trap_id) FROM u, h WHERE trap_id IN (SELECT o FROM t)")
def join_11_trap_ids(spark, sf_dir):
    f = views.trap_frames(spark, sf_dir)
    wanted = f.select(F.col("trap_id").alias("key")).distinct()
    return joins.free_ids(wanted, f.where("frame % 7 = 0").select(F.col("trap_id").alias("o")), "key", "o").select("key", "trap_id")


# --- trajectories ---------------------------------------------------------------------------

SEGMENTS = """, s AS (SELECT * FROM (SELECT *, lead(x) OVER w AS x_end, lead(y) OVER w AS y_end, lead(arrival) OVER w AS arrival_end FROM waypoints WINDOW w AS (PARTITION BY trajectory ORDER BY seq)) WHERE arrival_end IS NOT NULL)"""


@query(with_views("waypoints") + SEGMENTS + f", t AS (SELECT trajectory, CAST(unnest(range(1250, 250 + max(arrival), 500)) AS BIGINT) AS t FROM waypoints GROUP BY trajectory HAVING max(arrival) > 1000), j AS (SELECT t.trajectory, t, x, y, x_end, y_end, (t - arrival) / CAST(arrival_end - arrival AS DOUBLE) AS q FROM t JOIN s ON s.trajectory = t.trajectory AND arrival < t AND t <= arrival_end), k AS (SELECT *, q * q * q * (10e0 + q * (-15e0 + 6e0 * q)) AS p FROM j) SELECT trajectory, t, {R('x + (x_end - x) * p')} AS x, {R('y + (y_end - y) * p')} AS y FROM k")
def join_18_sampled_positions(spark, sf_dir):
    way = views.waypoints(spark, sf_dir)
    span = way.groupBy("trajectory").agg(F.max("arrival").alias("last")).where("last > 1000")
    times = span.select("trajectory", F.explode(F.sequence(F.lit(1250).cast("long"), F.col("last") + 249, F.lit(500).cast("long"))).alias("t")).where("t < last + 250")
    return joins.sample_at(way, times).select("trajectory", "t", r6("x").alias("x"), r6("y").alias("y"))


@query(with_views("waypoints") + SEGMENTS + f", l AS (SELECT trajectory, seq, sqrt((x_end-x)*(x_end-x)+(y_end-y)*(y_end-y)) AS d FROM s) SELECT trajectory, count(*) AS n_segments, {R('sum(d)')} AS length, {R('max(1875e-3 * d / 1e3)')} AS max_speed, count(*) FILTER (WHERE d <= 1e-9) AS n_waits, min(seq) FILTER (WHERE d > 1e-9) AS first_moving, max(seq) FILTER (WHERE d > 1e-9) AS last_moving FROM l GROUP BY trajectory")
def agg_05_path_lengths(spark, sf_dir):
    s = joins.segments(views.waypoints(spark, sf_dir))
    d = geometry.distance((F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end")))
    s = s.withColumn("d", d)
    moving = F.col("d") > lit(1e-9)
    return s.groupBy("trajectory").agg(F.count("*").alias("n_segments"), r6(F.sum("d")).alias("length"), r6(F.max(lit(motion.PEAK_SPEED) * F.col("d") / lit(1000))).alias("max_speed"), F.count_if(~moving).alias("n_waits"), F.min(F.when(moving, F.col("seq"))).alias("first_moving"), F.max(F.when(moving, F.col("seq"))).alias("last_moving"))


@query(with_views("waypoints") + SEGMENTS + f" SELECT trajectory, seq, {R('max(1875e-3 * sqrt((x_end-x)*(x_end-x)+(y_end-y)*(y_end-y)) / 1e3) OVER w')} AS speed_so_far, max(1875e-3 * sqrt((x_end-x)*(x_end-x)+(y_end-y)*(y_end-y)) / 1e3) OVER w > 15e-2 AS over_limit FROM s WINDOW w AS (PARTITION BY trajectory ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def agg_18_running_limits(spark, sf_dir):
    s = joins.segments(views.waypoints(spark, sf_dir))
    v = lit(motion.PEAK_SPEED) * geometry.distance((F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end"))) / lit(1000)
    top = F.max(v).over(W.partitionBy("trajectory").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return s.select("trajectory", "seq", r6(top).alias("speed_so_far"), (top > lit(0.15)).alias("over_limit"))


@query(with_views("waypoints") + SEGMENTS + ", d AS (SELECT trajectory, seq, sqrt((x_end-x)*(x_end-x)+(y_end-y)*(y_end-y)) AS l FROM s), g AS (SELECT *, greatest(1875e-3 * l / 1e-1, sqrt(5774e-3 * l / 1e-3), cbrt(60e0 * l / 1e-5), 1e2) AS t FROM d) SELECT trajectory, seq, CASE WHEN t <= 0 THEN 0e0 ELSE ceil(t / 1e2 - 1e-12) * 1e2 END AS duration FROM g")
def sca_07_durations(spark, sf_dir):
    s = joins.segments(views.waypoints(spark, sf_dir))
    length = geometry.distance((F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end")))
    return s.select("trajectory", "seq", motion.segment_duration(length, lit(0.1), lit(1e-3), lit(1e-5), lit(100)).alias("duration"))


@query(with_views("waypoints") + SEGMENTS + f", l AS (SELECT trajectory, seq, sqrt((x_end-x)*(x_end-x)+(y_end-y)*(y_end-y)) AS d, (trajectory * 31 + seq * 17) % 65 / 64e0 AS t FROM s) SELECT trajectory, seq, t, {R('30e0 * d * (t * (1e0 - t)) ** 2')} AS speed, {R('60e0 * d * t * (1e0 - t) * (1e0 - 2e0 * t)')} AS acceleration, {R('60e0 * d * (1e0 - 6e0 * t * (1e0 - t))')} AS jerk FROM l")
def sca_67_motion_profile(spark, sf_dir):
    """Speed, acceleration and jerk of minimum-jerk motion at a place in time of each segment, in units of
    its duration."""
    s = joins.segments(views.waypoints(spark, sf_dir))
    d = geometry.distance((F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end")))
    s = s.select("trajectory", "seq", d.alias("d"), ((F.col("trajectory") * 31 + F.col("seq") * 17) % 65 / lit(64)).alias("t"))
    t = F.col("t")
    return s.select("trajectory", "seq", "t", r6(F.col("d") * motion.speed(t)).alias("speed"), r6(F.col("d") * motion.acceleration(t)).alias("acceleration"), r6(F.col("d") * motion.jerk(t)).alias("jerk"))


@query(with_views("waypoints") + ", p AS (SELECT trajectory, seq, arrival, CASE WHEN arrival >= 3000 THEN arrival + 100 ELSE arrival END AS arrival_new FROM waypoints) SELECT trajectory, seq, arrival_new FROM p UNION ALL SELECT trajectory, 0, 3000 FROM p GROUP BY trajectory HAVING max(arrival) >= 3000")
def win_07_time_shift(spark, sf_dir):
    way = views.waypoints(spark, sf_dir)
    moved = way.select("trajectory", "seq", F.when(F.col("arrival") >= 3000, F.col("arrival") + 100).otherwise(F.col("arrival")).alias("arrival_new"))
    added = way.groupBy("trajectory").agg(F.max("arrival").alias("last")).where("last >= 3000").select("trajectory", F.lit(0).alias("seq"), F.lit(3000).cast("long").alias("arrival_new"))
    return moved.unionByName(added)


@query(with_views("waypoints", "ways") + SEGMENTS.replace("FROM waypoints", "FROM ways") + ", q AS (SELECT a.trajectory AS a_id, b.trajectory AS b_id, a.seq, a.x AS ax, a.y AS ay, a.x_end AS bx, a.y_end AS by_, b.x AS cx, b.y AS cy, b.x_end AS dx, b.y_end AS dy FROM s a JOIN s b ON a.seq = b.seq AND b.trajectory > a.trajectory), o AS (SELECT *, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS o1, (bx-ax)*(dy-ay)-(by_-ay)*(dx-ax) AS o2, (dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) AS o3, (dx-cx)*(by_-cy)-(dy-cy)*(bx-cx) AS o4 FROM q), c AS (SELECT *, (o1 * o2 < 0 AND o3 * o4 < 0) OR (abs(o1) <= 1e-10 AND cx BETWEEN least(ax,bx)-1e-10 AND greatest(ax,bx)+1e-10 AND cy BETWEEN least(ay,by_)-1e-10 AND greatest(ay,by_)+1e-10) OR (abs(o2) <= 1e-10 AND dx BETWEEN least(ax,bx)-1e-10 AND greatest(ax,bx)+1e-10 AND dy BETWEEN least(ay,by_)-1e-10 AND greatest(ay,by_)+1e-10) OR (abs(o3) <= 1e-10 AND ax BETWEEN least(cx,dx)-1e-10 AND greatest(cx,dx)+1e-10 AND ay BETWEEN least(cy,dy)-1e-10 AND greatest(cy,dy)+1e-10) OR (abs(o4) <= 1e-10 AND bx BETWEEN least(cx,dx)-1e-10 AND greatest(cx,dx)+1e-10 AND by_ BETWEEN least(cy,dy)-1e-10 AND greatest(cy,dy)+1e-10) AS hit FROM o) SELECT a_id, b_id, min(seq) AS first_conflict, count(*) AS n_conflicts FROM c WHERE hit GROUP BY a_id, b_id")
def join_12_path_conflicts(spark, sf_dir):
    """First and number of crossings of simultaneous segments, for all pairs of trajectories."""
    return joins.crossings(joins.segments(views.ways(spark, sf_dir)))


# --- frames ---------------------------------------------------------------------------------


@query(with_views("frames") + f", g AS (SELECT frame, count(*) AS n_traps, avg(intensity) AS m, stddev_pop(intensity) AS s, min(intensity) AS lo, max(intensity) AS hi, sum(intensity) AS p FROM frames GROUP BY frame) SELECT frame, n_traps, floor(m * 1e9 + 5e-1) / 1e9 AS mean, floor(s * 1e9 + 5e-1) / 1e9 AS std, {R('lo')} AS least, {R('hi')} AS most, {R('CASE WHEN m > 0 THEN s / m ELSE 0 END')} AS variation, CASE WHEN m > 0 THEN s / m ELSE 0 END <= 6e-1 AS accepted FROM g")
def agg_09_frame_metrics(spark, sf_dir):
    found = frames.gates(frames.metrics(views.trap_frames(spark, sf_dir)), variation=0.6)
    return found.select("frame", "n_traps", *[r9(c).alias(c) for c in ("mean", "std")], *[r6(c).alias(c) for c in ("least", "most", "variation")], "accepted")


@query(with_views("frames") + f", l AS (SELECT *, lag(frame) OVER w AS f0, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(intensity) OVER w AS i0, lag(phase) OVER w AS p0 FROM frames WINDOW w AS (PARTITION BY trap_id ORDER BY frame)) SELECT trap_id, frame, f0 IS NULL AS born, frame - f0 AS gap, {R('sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0))')} AS step, {R('intensity - i0')} AS intensity_change, {R('abs(' + WRAP('phase - p0') + ')')} AS phase_change FROM l")
def win_01_lifecycle(spark, sf_dir):
    return frames.lifecycle(views.trap_frames(spark, sf_dir)).select("trap_id", "frame", "born", "gap", *[r6(c).alias(c) for c in ("step", "intensity_change", "phase_change")])


@query(with_views("frames") + f" SELECT a.frame, {R('max(abs(' + WRAP('a.phase - b.phase') + '))')} AS max_phase_change, count(*) AS n_common FROM frames a JOIN frames b ON a.trap_id = b.trap_id AND a.frame = b.frame + 1 GROUP BY a.frame")
def join_24_phase_change(spark, sf_dir):
    return frames.phase_change(views.trap_frames(spark, sf_dir)).select("frame", r6("max_phase_change").alias("max_phase_change"), "n_common")


@query(with_views("frames") + f", b AS (SELECT frame, sqrt(intensity) AS d, sqrt(intensity) * (1e0 + phase / 1e2) AS a FROM frames), s AS (SELECT frame, CASE WHEN sum(d * d) <> 0 THEN sum(d * a) / sum(d * d) ELSE 1 END AS scale FROM b GROUP BY frame) SELECT b.frame, {R('max(scale)')} AS scale, {R('max(abs(a - scale * d) / (abs(scale * d) + 1e-12))')} AS worst FROM b JOIN s ON b.frame = s.frame GROUP BY b.frame")
def agg_12_amplitude_fit(spark, sf_dir):
    return frames.amplitude_fit(views.trap_frames(spark, sf_dir)).select("frame", r6("scale").alias("scale"), r6("worst").alias("worst"))


@query(with_views("frames") + f" SELECT frame, trap_id, {R('CASE WHEN avg(intensity) OVER w > 0 THEN intensity / avg(intensity) OVER w ELSE intensity END')} AS weight FROM frames WINDOW w AS (PARTITION BY frame)")
def agg_15_weights(spark, sf_dir):
    return frames.weights(views.trap_frames(spark, sf_dir)).select("frame", "trap_id", r6("weight").alias("weight"))


@query(with_views("frames") + ", l AS (SELECT frame, 16 + 45 * count(*) AS byte_length FROM frames GROUP BY frame) SELECT frame, byte_length, CAST(coalesce(sum(byte_length) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM l")
def snk_06_byte_index(spark, sf_dir):
    return frames.byte_index(views.trap_frames(spark, sf_dir))


@query(with_views("frames") + f" SELECT a.frame, {R('min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)))')} AS least, count(*) AS n_pairs FROM frames a JOIN frames b ON a.frame = b.frame AND a.trap_id < b.trap_id GROUP BY a.frame")
def join_21_frame_separation(spark, sf_dir):
    """The least distance and the number of pairs over all traps of a frame."""
    return frames.closest(views.trap_frames(spark, sf_dir)).select("frame", r6("least").alias("least"), "n_pairs")


@query(with_views("frames") + " SELECT trap_id, list(frame ORDER BY frame) AS frames_seen, count(*) AS n FROM frames GROUP BY trap_id")
def gen_02_pivot(spark, sf_dir):
    f = views.trap_frames(spark, sf_dir)
    return f.groupBy("trap_id").agg(F.sort_array(F.collect_list("frame")).alias("frames_seen"), F.count("*").alias("n"))


@query(with_views("frames") + ", b AS (SELECT frame + 1 AS frame, count(*) AS n_before, min(intensity) AS least_before FROM frames GROUP BY frame), a AS (SELECT frame, count(*) AS n_now, min(intensity) AS least_now FROM frames GROUP BY frame) SELECT frame, n_now, n_before, n_now IS DISTINCT FROM n_before AS differs, " + R("least(coalesce(least_now, least_before), coalesce(least_before, least_now))") + " AS least_either FROM a FULL JOIN b USING (frame)")
def join_32_index_compare(spark, sf_dir):
    f = views.trap_frames(spark, sf_dir)
    now = f.groupBy("frame").agg(F.count("*").alias("n_now"), F.min("intensity").alias("least_now"))
    before = f.groupBy((F.col("frame") + 1).alias("frame")).agg(F.count("*").alias("n_before"), F.min("intensity").alias("least_before"))
    both = now.join(before, "frame", "full_outer")
    return both.select("frame", "n_now", "n_before", (~F.col("n_now").eqNullSafe(F.col("n_before"))).alias("differs"), r6(F.least("least_now", "least_before")).alias("least_either"))


# --- fields ---------------------------------------------------------------------------------

AT = [(3.25, 1.5), (0.0, 0.0), (6.6, 4.7)]
P = "2e0 * pi() * (u * x / 8e0 + v * y / 8e0)"
SAMPLED = ", a AS (SELECT * FROM (VALUES (0, 325e-2, 15e-1), (1, 0e0, 0e0), (2, 66e-1, 47e-1)) AS t(k, u, v)), n AS (SELECT field_id, k, any_value(u) AS u, any_value(v) AS v, sum(re * cos(" + P + ")) AS re, -sum(re * sin(" + P + ")) AS im FROM fields, a GROUP BY field_id, k)"
SPECTRUM = ", k AS (SELECT unnest(range(0, 8)) AS k), r1 AS (SELECT field_id, y, k AS u, sum(re * cos(2e0 * pi() * (k * x % 8) / 8e0)) AS re, -sum(re * sin(2e0 * pi() * (k * x % 8) / 8e0)) AS im FROM fields, k GROUP BY field_id, y, k), sp AS (SELECT field_id, CAST(k AS INTEGER) AS v, CAST(u AS INTEGER) AS u, sum(re * cos(2e0 * pi() * (k * y % 8) / 8e0) + im * sin(2e0 * pi() * (k * y % 8) / 8e0)) AS re, sum(im * cos(2e0 * pi() * (k * y % 8) / 8e0) - re * sin(2e0 * pi() * (k * y % 8) / 8e0)) AS im FROM r1, k GROUP BY field_id, k, u), pw AS (SELECT field_id, (v + 4) % 8 AS py, (u + 4) % 8 AS px, re * re + im * im AS power FROM sp)"


@query(with_views("fields") + SAMPLED + f" SELECT field_id, CAST(k AS INTEGER) AS k, {R('re')} AS re, {R('im')} AS im FROM n")
def num_07_fourier_sample(spark, sf_dir):
    return fields.sample(views.fields(spark, sf_dir), AT).select("field_id", "k", r6("re").alias("re"), r6("im").alias("im"))


@query(with_views("fields") + SPECTRUM + f" SELECT field_id, v, u, {R('re')} AS re, {R('im')} AS im FROM sp")
def num_02_transform(spark, sf_dir):
    return fields.transform(views.fields(spark, sf_dir)).select("field_id", "v", "u", r6("re").alias("re"), r6("im").alias("im"))


@query(with_views("fields") + SPECTRUM + f", g AS (SELECT field_id, max(power) AS peak, avg(power) AS mean, max(CASE WHEN py = 4 AND px = 4 THEN power END) AS z FROM pw GROUP BY field_id) SELECT field_id, {R('peak')} AS peak, {R('mean')} AS mean, {R('z')} AS zero_order, {R('CASE WHEN mean > 0 THEN peak / mean ELSE 0 END')} AS peak_over_mean FROM g")
def agg_23_forward_summary(spark, sf_dir):
    found = fields.summary(fields.shifted(fields.transform(views.fields(spark, sf_dir))))
    return found.select("field_id", *[r6(c).alias(c) for c in ("peak", "mean", "zero_order", "peak_over_mean")])


@query(with_views("fields") + SPECTRUM + f" SELECT field_id, {R('max(power)')} AS ghost FROM pw WHERE least(abs(py - 2), 8 - abs(py - 2)) ** 2 + least(abs(px - 3), 8 - abs(px - 3)) ** 2 > 225e-2 AND least(abs(py - 7), 8 - abs(py - 7)) ** 2 + least(abs(px - 6), 8 - abs(px - 6)) ** 2 > 225e-2 GROUP BY field_id")
def join_30_ghost(spark, sf_dir):
    power = fields.shifted(fields.transform(views.fields(spark, sf_dir)))
    return fields.ghost(power, [(2, 3), (7, 6)]).select("field_id", r6("ghost").alias("ghost"))


@query(with_views("fields") + SAMPLED + f", g AS (SELECT unnest(range(0, 8)) AS g), b AS (SELECT field_id, CAST(gy.g AS INTEGER) AS y, CAST(gx.g AS INTEGER) AS x, sum(re * cos(2e0 * pi() * (u * gx.g / 8e0 + v * gy.g / 8e0)) - im * sin(2e0 * pi() * (u * gx.g / 8e0 + v * gy.g / 8e0))) AS re, sum(re * sin(2e0 * pi() * (u * gx.g / 8e0 + v * gy.g / 8e0)) + im * cos(2e0 * pi() * (u * gx.g / 8e0 + v * gy.g / 8e0))) AS im FROM n, g AS gx, g AS gy GROUP BY 1, 2, 3) SELECT field_id, y, x, {R('re')} AS re, {R('im')} AS im FROM b")
def num_08_adjoint(spark, sf_dir):
    back = fields.adjoint_phase(fields.sample(views.fields(spark, sf_dir), AT), AT)
    return back.select("field_id", "y", "x", r6("re").alias("re"), r6("im").alias("im"))


@query(with_views("fields") + SAMPLED + f", g AS (SELECT unnest(range(0, 8)) AS g), b AS (SELECT field_id, CAST(gy.g AS INTEGER) AS y, CAST(gx.g AS INTEGER) AS x, sum(re * cos(2e0 * pi() * (u * gx.g / 8e0 + v * gy.g / 8e0)) - im * sin(2e0 * pi() * (u * gx.g / 8e0 + v * gy.g / 8e0))) AS re, sum(re * sin(2e0 * pi() * (u * gx.g / 8e0 + v * gy.g / 8e0)) + im * cos(2e0 * pi() * (u * gx.g / 8e0 + v * gy.g / 8e0))) AS im FROM n, g AS gx, g AS gy GROUP BY 1, 2, 3) SELECT field_id, y, x, {R('CASE WHEN sqrt(re * re + im * im) < 5e-1 THEN (x - y) / 8e0 ELSE atan2(im, re) END')} AS phase, sqrt(re * re + im * im) < 5e-1 AS kept FROM b")
def num_08_phases(spark, sf_dir):
    """Phase of the back-projected samples; where they cancel, the phase that the pixel had is kept."""
    back = fields.adjoint_phase(fields.sample(views.fields(spark, sf_dir), AT), AT)
    kept = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) < lit(0.5)
    phase = F.when(kept, (F.col("x") - F.col("y")) / lit(8)).otherwise(F.atan2("im", "re"))
    return back.select("field_id", "y", "x", r6(phase).alias("phase"), kept.alias("kept"))


@query(with_views("fields") + ", c AS (SELECT *, greatest(0e0, least(255e0, floor((greatest(-3e0, least(3e0, re * 1e1)) + pi()) / (2e0 * pi()) * 255e0 + 5e-1))) AS code FROM fields) SELECT field_id, y, x, CAST(code AS INTEGER) AS code, " + R("code / 255e0 * 2e0 * pi() - pi()") + " AS phase FROM c")
def sca_41_quantize(spark, sf_dir):
    f = views.fields(spark, sf_dir)
    code = optics.quantize(numeric.clamp(F.col("re") * lit(10), lit(-3), lit(3)))
    return f.select("field_id", "y", "x", code.alias("code")).withColumn("phase", r6(optics.dequantize(F.col("code"))))


@query(with_views("fields") + f", p AS (SELECT a.field_id, a.y, a.x, a.re, b.re AS was FROM fields a JOIN fields b ON a.field_id = b.field_id + 1 AND a.y = b.y AND a.x = b.x) SELECT field_id, {R('max(abs(re - was))')} AS max_change, {R('coalesce(corr(re, was), 0)')} AS alike, {R('sqrt(avg((re - was) * (re - was)))')} AS rmse FROM p GROUP BY field_id")
def agg_16_change_between_fields(spark, sf_dir):
    f = views.fields(spark, sf_dir)
    before = f.select((F.col("field_id") + 1).alias("field_id"), "y", "x", F.col("re").alias("was"))
    both = f.join(before, ["field_id", "y", "x"])
    d = F.col("re") - F.col("was")
    return both.groupBy("field_id").agg(r6(F.max(F.abs(d))).alias("max_change"), r6(F.coalesce(F.corr("re", "was"), lit(0))).alias("alike"), r6(F.sqrt(F.avg(d * d))).alias("rmse"))


# --- rasters --------------------------------------------------------------------------------

BRIGHT = ", t AS (SELECT CAST(floor(avg(level)) + 3 AS BIGINT) AS t FROM raster), b AS (SELECT raster.* FROM raster, t WHERE level >= t)"


def _bright(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    image = views.raster(spark, sf_dir)
    threshold = int(image.agg(F.floor(F.avg("level")) + 3).first()[0])
    return rasters.bright(image, threshold), threshold


BINS = ", g AS (SELECT CAST(py // 8 AS INTEGER) AS cy, CAST(px // 8 AS INTEGER) AS cx, count(*) AS area, CAST(sum(level) AS BIGINT) AS total, max(level) AS peak, sum(px * level) / CAST(sum(level) AS DOUBLE) AS x, sum(py * level) / CAST(sum(level) AS DOUBLE) AS y FROM b GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(with_views("raster") + BRIGHT + BINS + f" SELECT cy, cx, area, total, peak, {R('x')} AS x, {R('y')} AS y FROM g")
def agg_22_grid_bins(spark, sf_dir):
    return rasters.bins(_bright(spark, sf_dir)[0], 8, 2).select("cy", "cx", "area", "total", "peak", r6("x").alias("x"), r6("y").alias("y"))


@query(with_views("raster") + BRIGHT + BINS + f" SELECT cy, cx, total, peak FROM g ORDER BY total DESC, peak DESC, cy, cx LIMIT 10")
def srt_01_strongest(spark, sf_dir):
    return rasters.strongest(rasters.bins(_bright(spark, sf_dir)[0], 8, 2), 10).select("cy", "cx", "total", "peak")


@query("WITH RECURSIVE " + views.SQL["raster"] + BRIGHT.replace(", t AS", ",\nt AS", 1) + f", e AS (SELECT a.py * 64 + a.px AS p, c.py * 64 + c.px AS q FROM b a JOIN b c ON abs(a.py - c.py) <= 1 AND abs(a.px - c.px) <= 1), reach AS (SELECT p, p AS q FROM e UNION SELECT r.p, e.q FROM reach r JOIN e ON r.q = e.p), lab AS (SELECT p, min(q) AS label FROM reach GROUP BY p), s AS (SELECT CAST(label AS INTEGER) AS label, count(*) AS area, max(level) AS peak, CAST(sum(level - t + 1) AS BIGINT) AS total, sum(px * (level - t + 1)) / CAST(sum(level - t + 1) AS DOUBLE) AS x, sum(py * (level - t + 1)) / CAST(sum(level - t + 1) AS DOUBLE) AS y FROM b JOIN lab ON b.py * 64 + b.px = p, t GROUP BY label) SELECT label, area, peak, total, {R('x')} AS x, {R('y')} AS y FROM s WHERE area >= 2")
def agg_21_components(spark, sf_dir):
    pixels, threshold = _bright(spark, sf_dir)
    found = rasters.spots(rasters.components(pixels, 64), threshold, 2)
    return found.select("label", "area", "peak", "total", r6("x").alias("x"), r6("y").alias("y"))


@query(with_views("points") + ", n AS (SELECT point_id, row_number() OVER (ORDER BY y, x, point_id) - 1 AS number FROM points), c AS (SELECT count(*) AS n FROM points), w AS (SELECT DISTINCT CAST(floor((i + 5e-1) * n / 1e2) AS BIGINT) AS number FROM c, (SELECT unnest(range(0, 100)) AS i)) SELECT point_id, number FROM n JOIN w USING (number)")
def srt_02_even_subsample(spark, sf_dir):
    p = views.points(spark, sf_dir).select("point_id", "y", "x")
    return rasters.even_subsample(p, ["y", "x", "point_id"], 100).select("point_id", "number")


@query(with_views("raster") + f" SELECT min(px) AS x_low, max(px) AS x_high, min(py) AS y_low, max(py) AS y_high, CAST(sum(level) AS BIGINT) AS total, {R('coalesce(corr(px, level), 0)')} AS tilt FROM raster")
def agg_08_image_moments(spark, sf_dir):
    return rasters.image_moments(views.raster(spark, sf_dir)).select("x_low", "x_high", "y_low", "y_high", "total", r6("tilt").alias("tilt"))


# --- scalars --------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, {R(WRAP('l_extendedprice / 1e2'))} AS wrapped, {R('abs(' + WRAP('l_extendedprice / 1e2 - l_quantity') + ')')} AS apart, {R('greatest(0e0, least(1e0, l_discount * 1e1)) ** 3 * (1e1 + greatest(0e0, least(1e0, l_discount * 1e1)) * (-15e0 + 6e0 * greatest(0e0, least(1e0, l_discount * 1e1))))')} AS smooth, CASE WHEN l_quantity <= 0 THEN 0e0 ELSE ceil(l_quantity / 7e0 - 1e-12) * 7e0 END AS rounded FROM lineitem")
def sca_01_phases(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    v = F.col("l_extendedprice") / lit(100)
    return d.select("l_orderkey", "l_linenumber", r6(numeric.wrap_phase(v)).alias("wrapped"), r6(numeric.angular_distance(v, F.col("l_quantity"))).alias("apart"), r6(numeric.smoothstep5(F.col("l_discount") * lit(10))).alias("smooth"), numeric.round_up(F.col("l_quantity"), lit(7)).alias("rounded"))


@query(with_views("points") + f", c AS (SELECT *, x - 3e2 AS dx, y - 4e1 AS dy FROM points) SELECT point_id, sqrt(dx * dx + dy * dy) <= 5e1 + 1e0 AS in_circle, sqrt(greatest(1e1 - x, x - 2e2, 0e0) ** 2 + greatest(1e1 - y, y - 3e1, 0e0) ** 2) <= 2e0 AS in_box, {R('sqrt((x - (1e1 + 19e1 * q)) ** 2 + (y - (1e1 + 2e1 * q)) ** 2)')} AS to_segment FROM (SELECT *, greatest(0e0, least(1e0, ((x - 1e1) * 19e1 + (y - 1e1) * 2e1) / (19e1 * 19e1 + 2e1 * 2e1))) AS q FROM c)")
def sca_23_regions(spark, sf_dir):
    p = views.points(spark, sf_dir)
    at = (F.col("x"), F.col("y"))
    return p.select("point_id", geometry.in_circle(at, (lit(300), lit(40)), lit(50), lit(1)).alias("in_circle"), geometry.in_box(at, (lit(10), lit(10)), (lit(200), lit(30)), lit(2)).alias("in_box"), r6(geometry.point_to_segment(at, (lit(10), lit(10)), (lit(200), lit(30)))).alias("to_segment"))


@query("""WITH m AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) % 4294967296 AS a0 FROM orders),
    m1 AS (SELECT o_orderkey, (xor(a0, a0 >> 16) * 2146121005::HUGEINT) % 4294967296 AS a FROM m),
    m2 AS (SELECT o_orderkey, (xor(a, a >> 15) * 2221713035::HUGEINT) % 4294967296 AS a FROM m1)
    SELECT o_orderkey, CAST(xor(a, a >> 16) AS BIGINT) AS mixed, floor(CAST(xor(a, a >> 16) AS DOUBLE) / 4294967296e0 * 1e6 + 5e-1) / 1e6 AS unit FROM m2""")
def sca_13_mix32(spark, sf_dir):
    mixed = hashing.mix32(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", mixed.alias("mixed"), r6(hashing.unit32(mixed)).alias("unit"))


@query(f"SELECT p_partkey, {R('(400e0 + p_size) * 1e-3 * 1e2 / 125e-1')} AS fov, {R('(400e0 + p_size) * 1e2 / (8e0 * 125e-1)')} AS null_at, {R('exp(-4e0 * p_size * p_size / 1e4)')} AS amplitude, {R('CASE WHEN abs(8e0 * sin(pi() * p_size / 64e0)) < 1e-12 THEN 1e0 ELSE abs(sin(pi() * 8e0 * p_size / 64e0) / (8e0 * sin(pi() * p_size / 64e0))) END')} AS mode, CAST(((p_partkey + 32) % 64 + 64) % 64 - 32 AS BIGINT) AS frequency, least(p_size % 50, 50 - p_size % 50) AS around, CASE WHEN p_size <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(p_size))) AS BIGINT) END AS power FROM part")
def sca_45_optics(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    wave = lit(400) + size
    return d.select(
        "p_partkey",
        r6(optics.field_of_view(wave * lit(1e-3), lit(100), lit(12.5))).alias("fov"),
        r6(optics.first_null(wave, lit(100), lit(8), lit(12.5))).alias("null_at"),
        r6(optics.gaussian_amplitude(size * size, lit(100))).alias("amplitude"),
        r6(optics.dirichlet(size, lit(8), lit(64))).alias("mode"),
        optics.principal_frequency(F.col("p_partkey"), F.lit(64)).cast("long").alias("frequency"),
        optics.periodic_distance(F.col("p_size"), F.lit(0), F.lit(50)).alias("around"),
        numeric.power_of_two_at_least(F.col("p_size")).alias("power"),
    )


@query(f"SELECT event_id, {R('CASE WHEN k <= 16 THEN k / 16e0 * 5e-1 WHEN k <= 64 THEN 5e-1 + (k - 16) / 48e0 * 15e-1 ELSE 2e0 + (least(k, 255) - 64) / 191e0 * 4e0 END')} AS phase FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def src_08_lookup_table(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", F.least(k, F.lit(255)).alias("k"))
    return rows.select("event_id", r6(joins.lookup(F.col("k"), [(0, 0.0), (16, 0.5), (64, 2.0), (255, 6.0)])).alias("phase"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def src_02_json_points(spark, sf_dir):
    found = F.from_json("props", "k bigint")
    return views.json_points(spark, sf_dir).groupBy(found["k"].alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT item_id, text AS value, sha256(text) AS digest FROM benchmark WHERE text IS NOT NULL")
def sca_63_digests(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.col("text").alias("value"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS byte_length, CAST(coalesce(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM documents")
def snk_05_descriptors(spark, sf_dir):
    """Size of every whole text and its running place in a concatenated file."""
    return sca_61_checksums(spark, sf_dir).drop("crc32")


@query()
def sca_61_checksums(spark, sf_dir):
    """crc32 and size of every whole text with its running place in a concatenated file."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    sized = d.select("doc_id", F.length("bytes").cast("long").alias("byte_length"), F.crc32("bytes").alias("crc32"))
    return order.running(sized, ["doc_id"], "byte_length", "byte_offset").select("doc_id", "byte_length", "crc32", "byte_offset")


# --- assignment, sources and sequences --------------------------------------------------------


@query()
def gen_12_assignment(spark, sf_dir):
    """All required sites get movable atoms at least total cost, in one problem; no atom stands twice."""
    movable = views.atoms(spark, sf_dir).where("movable").select("atom_id", "x", "y")
    found = auction.fill_sites(_matrix(spark, sf_dir), movable)
    return found.where("site_id is not null").select("site_id", "atom_id", r6("cost").alias("cost"))


@query()
def agg_02_assignment_cost(spark, sf_dir):
    """Total cost of the assignment and the number of its sites."""
    return gen_12_assignment(spark, sf_dir).agg(F.sum("cost").alias("total"), F.count("*").alias("n_sites"))


@query("SELECT event_id AS key, CAST(1 AS BIGINT) AS id, CAST(json_extract(props, '$.k') AS DOUBLE) AS x, CAST(event_id % 100 AS DOUBLE) AS y, TRUE AS ok FROM events UNION ALL SELECT event_id, 7, -15e-1, CAST(json_extract(props, '$.k') AS DOUBLE), TRUE FROM events")
def src_02_point_lists(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"points": [['), k, F.lit(", "), (F.col("event_id") % 100).cast("string"), F.lit('], {"id": 7, "xUm": -1.5, "y": '), k, F.lit("}]}"))
    return points.json_points(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), text.alias("text")), "key", "text")


@query("SELECT vec_id AS key, CAST(i AS INTEGER) AS site, CAST(i % 8 AS DOUBLE) AS x, CAST(i // 8 AS DOUBLE) AS y, CAST(NULL AS VARCHAR) AS error FROM embeddings, (SELECT unnest(range(0, 64)) AS i) WHERE embedding[i + 1] > 0")
def src_01_occupied_lattice(spark, sf_dir):
    sites = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct((i % 8).cast("double").alias("x"), F.floor(i / 8).cast("double").alias("y")))
    flags = F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), sites.alias("sites"), flags.alias("occupied"))
    return points.occupied_lattice(rows, "key", "sites", "occupied")


@query(with_views("frames") + " SELECT frame, frame * 21600000000 AS time, trap_id, CASE WHEN trap_id % 5 = 0 THEN NULL ELSE trap_id + 1000 END AS atom_id, x, y, intensity, phase, CAST(trap_id % 8 AS BIGINT) AS flags, CAST(NULL AS VARCHAR) AS error FROM frames")
def snk_03_packed_frames(spark, sf_dir):
    """Trap frames through the packed format and back."""
    f = views.trap_frames(spark, sf_dir)
    traps = f.select("frame", (F.col("frame") * F.lit(21600000000)).alias("time"), "trap_id", F.when(F.col("trap_id") % 5 != 0, F.col("trap_id") + 1000).alias("atom_id"), "x", "y", "intensity", "phase", (F.col("trap_id") % 8).alias("flags"))
    return packed.unpack_frames(packed.pack_frames(traps))


@query("WITH r AS (SELECT l_suppkey // 64 AS image, CAST(l_suppkey % 64 AS INTEGER) AS py, CAST(l_partkey % 64 AS INTEGER) AS px, count(*) AS level FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT image, max(py) + 1 AS h, max(px) + 1 AS w FROM r GROUP BY image), p AS (SELECT image, CAST(i // w AS INTEGER) AS y, CAST(i % w AS INTEGER) AS x FROM s, LATERAL (SELECT unnest(range(0, h * w)) AS i)) SELECT p.image, y, x, CAST(coalesce(level % 256, 0) AS INTEGER) AS level FROM p LEFT JOIN r ON r.image = p.image AND py = y AND px = x")
def snk_07_bitmap(spark, sf_dir):
    """Images of line counts, one for 64 suppliers, as bitmaps and back."""
    key = (F.col("l_suppkey") / 64).cast("long").alias("image")
    counts = table(spark, sf_dir, "lineitem").groupBy(key, (F.col("l_suppkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")).agg((F.count("*") % 256).alias("code"))
    return packed.pixels(packed.bitmaps(counts, "image"), "image")


@query("SELECT min(event_id) AS lowest, max(event_id) AS highest, count(event_id) AS n, count(DISTINCT event_id) AS different, count(event_id) = count(DISTINCT event_id) AND max(event_id) - min(event_id) + 1 = count(event_id) AS complete FROM events")
def stm_08_contiguous(spark, sf_dir):
    return sequence.contiguous(table(spark, sf_dir, "events"), "event_id")


# --- lookups, seeds and overlaps ------------------------------------------------------------

TIMES = ", t AS (SELECT trajectory, CAST(unnest(range(500, max(arrival) + 1000, 750)) AS BIGINT) AS t FROM waypoints GROUP BY trajectory)"


def _times(way: DataFrame) -> DataFrame:
    span = way.groupBy("trajectory").agg(F.max("arrival").alias("last"))
    return span.select("trajectory", F.explode(F.sequence(F.lit(500).cast("long"), F.col("last") + 999, F.lit(750).cast("long"))).alias("t"))


@query(with_views("waypoints") + TIMES + ", s AS (SELECT *, lead(x) OVER w AS x_end, lead(y) OVER w AS y_end, lead(arrival) OVER w AS arrival_end FROM waypoints WINDOW w AS (PARTITION BY trajectory ORDER BY seq)), j AS (SELECT t.trajectory, t, seq, x, y, x_end, y_end, CASE WHEN arrival_end IS NULL OR t < arrival THEN 0e0 ELSE (t - arrival) / CAST(arrival_end - arrival AS DOUBLE) END AS q FROM t JOIN s ON t.trajectory = s.trajectory AND (seq = 1 OR arrival <= t) AND (arrival_end IS NULL OR t < arrival_end)) SELECT trajectory, t, seq, " + R("CASE WHEN x_end IS NULL THEN x ELSE x + (x_end - x) * q END") + " AS x, " + R("CASE WHEN y_end IS NULL THEN y ELSE y + (y_end - y) * q END") + " AS y FROM j")
def join_17_step_and_line(spark, sf_dir):
    way = views.waypoints(spark, sf_dir)
    return joins.step_at(way, _times(way)).select("trajectory", "t", "seq", r6("x").alias("x"), r6("y").alias("y"))


def _dirichlet(d: str) -> str:
    below = f"(8e0 * sin(pi() * ({d}) / 64e0))"
    return f"CASE WHEN abs{below} < 1e-12 THEN 1e0 ELSE abs(sin(pi() * 8e0 * ({d}) / 64e0) / {below}) END"


@query(with_views("frames") + f", p AS (SELECT a.frame, a.trap_id AS a_id, b.trap_id AS b_id, (a.x - b.x) / 1e1 AS dx, (a.y - b.y) / 1e1 AS dy FROM frames a JOIN frames b ON a.frame = b.frame AND a.trap_id < b.trap_id), c AS (SELECT *, {R(f'greatest(({_dirichlet("dx")}) * ({_dirichlet("dy")}), exp(-5e-1 * (dx * dx + dy * dy)))')} AS overlap FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY overlap DESC, a_id, b_id) AS r FROM c) SELECT frame, max(overlap) AS worst, CAST(max(CASE WHEN r = 1 THEN a_id END) AS BIGINT) AS a_id, CAST(max(CASE WHEN r = 1 THEN b_id END) AS BIGINT) AS b_id, count(*) FILTER (WHERE overlap >= 98e-2) AS n_close FROM r GROUP BY frame")
def join_29_mode_overlap(spark, sf_dir):
    """Over all traps of a frame: the largest mode overlap, its first pair, and the unresolved pairs."""
    return frames.mode_overlap(views.trap_frames(spark, sf_dir), scale=10.0, active=8, extent=64)


@query(with_views("atoms") + f" SELECT grp, {R('min(x) - 15e-1')} AS x_low, {R('max(x) + 15e-1')} AS x_high, {R('min(y) - 15e-1')} AS y_low, {R('max(y) + 15e-1')} AS y_high FROM atoms GROUP BY grp")
def agg_07_bounds(spark, sf_dir):
    pad = lit(1.5)
    return views.atoms(spark, sf_dir).groupBy("grp").agg(r6(F.min("x") - pad).alias("x_low"), r6(F.max("x") + pad).alias("x_high"), r6(F.min("y") - pad).alias("y_low"), r6(F.max("y") + pad).alias("y_high"))


@query(with_views("points") + ", e AS (SELECT * FROM (VALUES (1e1, 1e1, 5e2, 2e1), (5e2, 2e1, 4e2, 6e1), (4e2, 6e1, 2e2, 3e1), (2e2, 3e1, 1e1, 1e1)) AS t(ax, ay, bx, by_)) SELECT point_id, count(*) FILTER (WHERE (ay > y) <> (by_ > y) AND x < ax + (bx - ax) * ((y - ay) / (by_ - ay))) % 2 = 1 AS inside FROM points, e GROUP BY point_id")
def sca_20_polygon(spark, sf_dir):
    xs, ys = F.array(*map(lit, (10, 500, 400, 200))), F.array(*map(lit, (10, 20, 60, 30)))
    return views.points(spark, sf_dir).select("point_id", geometry.in_polygon((F.col("x"), F.col("y")), xs, ys).alias("inside"))


@query(with_views("raster") + f" SELECT px, py, level, {R('(px - 315e-1) * 2e1 / 63e0')} AS x_um, {R('(315e-1 - py) * 12e0 / 63e0')} AS y_um FROM raster")
def sca_51_pixel_to_plane(spark, sf_dir):
    return views.raster(spark, sf_dir).select("px", "py", "level", r6((F.col("px") - lit(31.5)) * lit(20) / lit(63)).alias("x_um"), r6((lit(31.5) - F.col("py")) * lit(12) / lit(63)).alias("y_um"))


@query(with_views("points") + ", c AS (SELECT CAST(floor(y) AS BIGINT) + j AS cy, CAST(floor(x) AS BIGINT) + i AS cx, (point_id % 10 + 1) * (CASE WHEN i = 1 THEN x - floor(x) ELSE 1e0 - (x - floor(x)) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1e0 - (y - floor(y)) END) AS part FROM points, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)) SELECT cy, cx, floor(sum(part) * 1e5 + 5e-1 + 1e-4) / 1e5 AS total FROM c GROUP BY cy, cx")
def num_13_scatter(spark, sf_dir):
    p = views.points(spark, sf_dir).withColumn("v", (F.col("point_id") % 10 + 1).cast("double"))
    return joins.scatter(p, "v").select("cy", "cx", (F.floor(F.col("total") * lit(1e5) + lit(0.5001)) / lit(1e5)).alias("total"))


@query(with_views("waypoints") + ", a AS (SELECT trajectory, list_sort(list(arrival)) AS l FROM waypoints GROUP BY trajectory) SELECT a.trajectory, list_sort(list_distinct(list_concat(a.l, list_transform(b.l, lambda v: v + 500)))) AS breaks FROM a JOIN a b ON b.trajectory = a.trajectory + 1")
def set_03_breakpoints(spark, sf_dir):
    a = views.waypoints(spark, sf_dir).groupBy("trajectory").agg(F.collect_list("arrival").alias("l"))
    b = a.select((F.col("trajectory") - 1).alias("trajectory"), F.transform("l", lambda v: v + 500).alias("m"))
    return a.join(b, "trajectory").select("trajectory", F.array_sort(F.array_union("l", "m")).alias("breaks"))


@query("SELECT vec_id, len(embedding) AS n, len(list_filter(range(2, len(embedding) + 1), lambda i: embedding[i] < embedding[i - 1])) = 0 OR len(list_filter(range(2, len(embedding) + 1), lambda i: embedding[i] > embedding[i - 1])) = 0 AS monotone FROM embeddings")
def src_05_code_tables(spark, sf_dir):
    """Code tables of whole vectors."""
    text = F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), "; ")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), text.alias("text"))
    found = points.code_table(rows, "vec_id", "text").select("vec_id", "monotone")
    return rows.select("vec_id", "n").join(found, "vec_id")


@query("WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), s AS (SELECT c_custkey AS sample_id, (7919 * c_custkey + 13) % n AS stratum, n FROM customer, n) SELECT sample_id, stratum, CAST(floor(1e1 + 4e1 * stratum / greatest(n - 1, 1) + 5e-1) AS BIGINT) AS even_count, CAST(floor(exp(ln(2e3) * stratum / greatest(n - 1, 1)) + 5e-1) AS BIGINT) AS log_count FROM s")
def gen_15_schedule(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = c.agg(F.count("*").alias("n"))
    s = c.crossJoin(F.broadcast(n)).select(F.col("c_custkey").alias("sample_id"), F.pmod(F.col("c_custkey") * 7919 + 13, F.col("n")).alias("stratum"), F.greatest(F.col("n") - 1, F.lit(1)).alias("top"))
    return s.select("sample_id", "stratum", F.floor(lit(10) + lit(40) * F.col("stratum") / F.col("top") + lit(0.5)).cast("long").alias("even_count"), F.floor(F.exp(F.ln(lit(2000)) * F.col("stratum") / F.col("top")) + lit(0.5)).cast("long").alias("log_count"))


from lumenloom.plans import assembly, checks, codes, light, outputs, packaging, planning, routes, spectra  # noqa: E402, F401
