"""Assignment costs, destinations, trap frames in full, and what is written of a sequence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions import geometry
from lumenloom.functions.numeric import lit
from lumenloom.operators.lineage import cut
from lumenloom.operators import auction, frames, joins, order, rasters, repair
from lumenloom.plans import views
from lumenloom.plans.catalog import R, query, r6
from lumenloom.plans.routes import _to_segment
from lumenloom.plans.views import table, with_views
from lumenloom.sources import points, tables

EDGES = f""", pen AS (SELECT l_suppkey AS atom_id, CAST(l_linenumber AS BIGINT) AS site_id, count(*) * 1e1 AS penalty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
    e AS (SELECT a.atom_id, t.site_id, a.grp, t.grp AS t_grp, (a.x - t.x) ** 2 + (a.y - t.y) ** 2 AS d2, t.site_id % 7 = 3 AND t.site_id * 3 <> a.atom_id AS other_atom, t.site_id % 2 = 0 AND t.grp <> a.grp AS mismatch, {_to_segment('12e0', '9e0', 'a.x', 'a.y', 't.x', 't.y')} <= 2e0 AS obstacle,
    EXISTS (SELECT 1 FROM atoms s WHERE NOT s.movable AND {_to_segment('s.x', 's.y', 'a.x', 'a.y', 't.x', 't.y')} < 25e-2 - 1e-9) AS static_hit FROM atoms a, targets t WHERE a.movable AND t.required),
    c AS (SELECT e.atom_id, e.site_id, NOT other_atom AND NOT (mismatch AND e.site_id % 4 <> 0) AS feasible, (d2 + CASE WHEN obstacle THEN 1e3 ELSE 0 END + CASE WHEN static_hit THEN 1e2 ELSE 0 END + CASE WHEN mismatch THEN 1e3 ELSE 0 END) * CASE WHEN sqrt(d2) <= 25e-2 THEN 1e-3 ELSE 1 END + coalesce(penalty, 0) AS cost FROM e LEFT JOIN pen USING (atom_id, site_id))"""


def _edges(spark, sf_dir):
    atoms, sites = views.atoms(spark, sf_dir), views.targets(spark, sf_dir).where("required")
    key = F.col("site_id")
    wanted = sites.select("site_id", "x", "y", F.when(key % 7 == 3, key * 3).otherwise(-1).alias("required_atom"), F.when(key % 2 == 0, F.col("grp")).otherwise(-1).alias("required_group"), (key % 4 != 0).alias("forbid"))
    hit = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("atom_id"), F.col("l_linenumber").cast("long").alias("site_id")).agg((F.count("*") * lit(10)).alias("penalty"))
    blocked = lambda a, b: geometry.point_to_segment((lit(12), lit(9)), a, b) <= lit(2)
    return joins.edge_costs(atoms.where("movable"), wanted, atoms.where("not movable").select("x", "y"), hit, blocked)


@query(with_views("atoms", "targets") + EDGES + f" SELECT atom_id, site_id, feasible, CASE WHEN feasible THEN {R('cost')} ELSE 1e30 END AS cost FROM c")
def join_02_edge_costs(spark, sf_dir):
    """Every edge of the cost matrix with all its terms; forbidden ones cost 1e30."""
    return _edges(spark, sf_dir).select("atom_id", "site_id", "feasible", F.when(F.col("feasible"), r6("cost")).otherwise(lit(1e30)).alias("cost"))


@query(with_views("atoms") + ", p AS (SELECT k, k * 6e0 AS px, 12e0 AS py FROM (SELECT unnest(range(0, 4)) AS k)) SELECT atom_id, CAST(k AS INTEGER) AS k, " + R(f"(x - px) ** 2 + (y - py) ** 2 + CASE WHEN {_to_segment('12e0', '9e0', 'x', 'y', 'px', 'py')} <= 2e0 THEN 1e3 ELSE 0 END") + " AS cost FROM atoms, p WHERE movable")
def join_03_parking_costs(spark, sf_dir):
    """Cost of parking every movable atom at each of the parking sites."""
    spots = F.array(*[F.struct(F.lit(k).alias("k"), lit(6 * k).alias("px"), lit(12).alias("py")) for k in range(4)])
    a = views.atoms(spark, sf_dir).where("movable").select("atom_id", "x", "y", F.explode(spots).alias("p"))
    at, to = (F.col("x"), F.col("y")), (F.col("p.px"), F.col("p.py"))
    cost = geometry.distance_squared(at, to) + F.when(geometry.point_to_segment((lit(12), lit(9)), at, to) <= lit(2), lit(1000)).otherwise(lit(0))
    return a.select("atom_id", "p.k", r6(cost).alias("cost"))


@query()
def gen_13_dispositions(spark, sf_dir):
    """What becomes of every atom, by the policy for those without a site: kept, released in place, or
    parked. All sites and atoms are one problem for each kind of cost."""
    atoms, sites = views.atoms(spark, sf_dir), views.targets(spark, sf_dir)
    edges, movable = cut(_edges(spark, sf_dir).where("feasible")), atoms.where("movable").select("atom_id", "x", "y")
    parking = spark.createDataFrame([(0, 6.0, 12.0)], "spot long, x double, y double")
    still, parked = auction.fill_sites(edges, movable), auction.fill_sites(edges, movable, parking=parking)
    found = [auction.dispositions(atoms, sites, parked if "PARK" in policy else still, policy=policy, stay=0.25).select(F.lit(policy).alias("policy"), "*") for policy in auction.EXTRA]
    return reduce(DataFrame.unionByName, found).withColumn("cost", r6("cost"))


@query()
def stm_03_repaired_assignment(spark, sf_dir):
    """All sites served by atoms whose straight ways are clear of all others, or the last attempt with the
    number of its conflicts."""
    atoms, sites = views.atoms(spark, sf_dir), views.targets(spark, sf_dir)
    plan = repair.direct_ways(atoms, sites, minimum=0.3, margin=0.0, sigmas=1.0)
    found = repair.repaired(cut(_edges(spark, sf_dir).where("feasible")), plan, retries=3, penalty=50.0)
    return found.withColumn("cost", r6("cost"))


ASSIGNED = ", z AS (SELECT atom_id, CASE WHEN movable AND atom_id IN (SELECT site_id FROM targets) THEN atom_id END AS site_id, CASE WHEN NOT movable THEN 'STAY' WHEN atom_id IN (SELECT site_id FROM targets) THEN 'MOVE_TO_TARGET' WHEN atom_id % 3 = 0 THEN 'PARK' ELSE 'KEEP' END AS disposition FROM atoms), d AS (SELECT a.atom_id, a.x, a.y, z.site_id, disposition, coalesce(t.x, CASE WHEN disposition = 'PARK' THEN (a.atom_id % 4) * 6e0 END, a.x) AS to_x, coalesce(t.y, CASE WHEN disposition = 'PARK' THEN 12e0 END, a.y) AS to_y FROM atoms a JOIN z USING (atom_id) LEFT JOIN targets t ON t.site_id = z.site_id)"


def _destinations(spark, sf_dir):
    atoms, sites = views.atoms(spark, sf_dir), views.targets(spark, sf_dir)
    known = sites.select(F.col("site_id").alias("atom_id"), F.col("site_id").alias("site"))
    z = atoms.select("atom_id", "movable").join(known, "atom_id", "left")
    disposition = F.when(~F.col("movable"), "STAY").when(F.col("site").isNotNull(), "MOVE_TO_TARGET").when(F.col("atom_id") % 3 == 0, "PARK").otherwise("KEEP")
    z = z.select("atom_id", F.when(F.col("movable"), F.col("site")).alias("site_id"), disposition.alias("disposition"), (F.col("atom_id") % 4).cast("int").alias("k"))
    parking = [(6.0 * k, 12.0) for k in range(4)]
    return joins.destinations(atoms, z, sites, parking)


@query(with_views("atoms", "targets") + ASSIGNED + f" SELECT atom_id, site_id, disposition, {R('to_x')} AS to_x, {R('to_y')} AS to_y, CASE WHEN sqrt((to_x - x) ** 2 + (to_y - y) ** 2) > 1e-9 THEN [0, 1] ELSE [0] END AS ticks FROM d")
def join_09_destinations(spark, sf_dir):
    """Where every atom goes and the ticks of its direct path: one waypoint if it stays."""
    d = _destinations(spark, sf_dir)
    moving = geometry.distance((F.col("x"), F.col("y")), (F.col("to_x"), F.col("to_y"))) > lit(1e-9)
    return d.select("atom_id", "site_id", "disposition", r6("to_x").alias("to_x"), r6("to_y").alias("to_y"), F.when(moving, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("ticks"))


@query(with_views("waypoints", "targets") + ", l AS (SELECT trajectory, arg_max(x, seq) AS x, arg_max(y, seq) AS y FROM waypoints GROUP BY trajectory) SELECT site_id, trajectory IS NULL AS missing, " + R("sqrt((l.x - t.x) ** 2 + (l.y - t.y) ** 2)") + " AS off, coalesce(sqrt((l.x - t.x) ** 2 + (l.y - t.y) ** 2) > 1e-2, TRUE) AS mismatch FROM targets t LEFT JOIN l ON t.site_id = l.trajectory")
def join_25_final_positions(spark, sf_dir):
    """The last place of every site's path against the site."""
    way, sites = views.waypoints(spark, sf_dir), views.targets(spark, sf_dir)
    last = way.groupBy(F.col("trajectory").alias("site_id")).agg(F.max_by(F.struct(F.col("x").alias("lx"), F.col("y").alias("ly")), "seq").alias("l"))
    both = sites.join(last, "site_id", "left")
    off = geometry.distance((F.col("l.lx"), F.col("l.ly")), (F.col("x"), F.col("y")))
    return both.select("site_id", F.col("l").isNull().alias("missing"), r6(off).alias("off"), F.coalesce(off > lit(0.01), F.lit(True)).alias("mismatch"))


@query(with_views("frames") + " SELECT a.frame, a.trap_id, b.trap_id IS NULL AS gone, " + R("(a.x + coalesce(b.x, a.x)) / 2") + " AS x, " + R("(a.y + coalesce(b.y, a.y)) / 2") + " AS y, " + R("(a.intensity + coalesce(b.intensity, a.intensity)) / 2") + " AS intensity, " + R("(a.phase + coalesce(b.phase, a.phase)) / 2") + " AS phase FROM frames a LEFT JOIN frames b ON a.trap_id = b.trap_id AND b.frame = a.frame + 1")
def join_22_midpoints(spark, sf_dir):
    """The frame between two frames: states of the earlier one averaged with those of the later, or kept."""
    return frames.midpoints(views.trap_frames(spark, sf_dir)).select("frame", "trap_id", "gone", *[r6(c).alias(c) for c in ("x", "y", "intensity", "phase")])


@query(with_views("frames") + " SELECT frame, trap_id, " + R("coalesce(lag(phase) OVER w, phase)") + " AS start_phase, lag(frame) OVER w IS NULL AS seeded FROM frames WINDOW w AS (PARTITION BY trap_id ORDER BY frame)")
def join_23_phase_carry(spark, sf_dir):
    """The phase that a trap starts a frame with: its last one, or its own target for a new trap."""
    w = W.partitionBy("trap_id").orderBy("frame")
    before = F.lag("phase").over(w)
    return views.trap_frames(spark, sf_dir).select("frame", "trap_id", r6(F.coalesce(before, "phase")).alias("start_phase"), F.lag("frame").over(w).isNull().alias("seeded"))


@query(with_views("frames") + ", m AS (SELECT max(frame) AS top FROM frames) SELECT trap_id, frame, lead(frame) OVER w AS next_frame, frame < top AND coalesce(lead(frame) OVER w > frame + 1, TRUE) AS died, frame > 0 AND coalesce(lag(frame) OVER w < frame - 1, TRUE) AS born FROM frames, m WINDOW w AS (PARTITION BY trap_id ORDER BY frame)")
def win_01_births_and_deaths(spark, sf_dir):
    """Traps that a frame has and the one before or behind it lacks."""
    f = views.trap_frames(spark, sf_dir)
    w = W.partitionBy("trap_id").orderBy("frame")
    top = f.agg(F.max("frame").alias("top"))
    after, before = F.lead("frame").over(w), F.lag("frame").over(w)
    return f.crossJoin(F.broadcast(top)).select("trap_id", "frame", after.alias("next_frame"), ((F.col("frame") < F.col("top")) & F.coalesce(after > F.col("frame") + 1, F.lit(True))).alias("died"), ((F.col("frame") > 0) & F.coalesce(before < F.col("frame") - 1, F.lit(True))).alias("born"))


STEP = "(greatest(0e0, least(1e0, {0})) ** 3 * (1e1 + greatest(0e0, least(1e0, {0})) * (-15e0 + 6e0 * greatest(0e0, least(1e0, {0})))))"
FRAMES = with_views("waypoints") + f""", s AS (SELECT *, lead(x) OVER w AS x_end, lead(y) OVER w AS y_end, lead(arrival) OVER w AS arrival_end FROM waypoints WINDOW w AS (PARTITION BY trajectory ORDER BY seq)), g AS (SELECT trajectory, any_value(instrument) AS instrument, min(arrival) AS first_at, max(arrival) AS last_at, 5e-1 + (trajectory % 4) * 25e-2 AS final, count(*) > 1 AS moving FROM waypoints GROUP BY trajectory),
    h AS (SELECT *, ceil(1875e-3 * abs(final - 12e-1) / 5e-1) * 500 AS settle, CASE WHEN trajectory % 4 = 3 THEN ceil(1875e-3 * final / 5e-1) * 500 ELSE 0 END AS release FROM g), e AS (SELECT instrument, ceil(max(last_at + settle + release) / 5e2) * 500 AS total FROM h GROUP BY instrument),
    t AS (SELECT h.*, CAST(unnest(range(0, CAST(total AS BIGINT) + 1, 500)) AS BIGINT) AS t FROM h JOIN e USING (instrument)),
    p AS (SELECT t.*, s.x, s.y, x_end, y_end, CASE WHEN arrival_end IS NULL OR t <= arrival THEN 0e0 ELSE (t - arrival) / CAST(arrival_end - arrival AS DOUBLE) END AS q FROM t JOIN s ON s.trajectory = t.trajectory AND (t > arrival OR (seq = 1 AND t <= arrival)) AND (arrival_end IS NULL OR t <= arrival_end)),
    i AS (SELECT *, CASE WHEN t < first_at - 1000 THEN 8e-1 WHEN t < first_at THEN 8e-1 + 4e-1 * {STEP.format('(t - (first_at - 1000)) / 1e3')} WHEN t <= last_at THEN 12e-1 ELSE (12e-1 + (final - 12e-1) * {STEP.format('(t - last_at) / settle')}) * CASE WHEN release > 0 THEN 1 - {STEP.format('(t - (last_at + settle)) / release')} ELSE 1 END END AS intensity, {STEP.format('q')} AS k FROM p)"""


@query(FRAMES + f" SELECT CAST(t / 500 AS BIGINT) AS frame, trajectory AS trap_id, CASE WHEN intensity > 1e-9 THEN trajectory END AS atom_id, {R('x + coalesce(x_end - x, 0) * k')} AS x, {R('y + coalesce(y_end - y, 0) * k')} AS y, {R('intensity')} AS intensity, CASE WHEN intensity <= 1e-9 THEN 2 WHEN moving THEN 1 ELSE 0 END AS flags FROM i UNION ALL SELECT CAST(f / 500 AS BIGINT), 10000000 + instrument, CASE WHEN instrument % 2 = 0 THEN instrument END, -5e0, {R('instrument * 1e0')}, 1e0, CASE WHEN instrument % 2 = 0 THEN 4 ELSE 0 END FROM (SELECT instrument, unnest(range(0, CAST(total AS BIGINT) + 1, 500)) AS f FROM e)")
def gen_01_trap_frames(spark, sf_dir):
    """All traps of all frames of every plane: moving ones with their intensities and releases, and the
    plane's static trap."""
    way = views.waypoints(spark, sf_dir)
    plans = way.groupBy("trajectory").agg((lit(0.5) + (F.col("trajectory") % 4) * lit(0.25)).alias("final"), (F.col("trajectory") % 4 == 3).alias("released"))
    fixed = way.select("instrument").distinct().select("instrument", (F.col("instrument") + 10_000_000).alias("trap_id"), F.when(F.col("instrument") % 2 == 0, F.col("instrument")).alias("atom_id"), lit(-5).alias("x"), F.col("instrument").cast("double").alias("y"), lit(1).alias("intensity"))
    found = frames.sampled(way, plans, fixed, period=500, initial=0.8, moving=1.2, change=0.5)
    return found.select("frame", "trap_id", "atom_id", r6("x").alias("x"), r6("y").alias("y"), r6("intensity").alias("intensity"), "flags")


@query(FRAMES + " SELECT instrument, CAST(max(last_at) AS BIGINT) AS makespan, count(*) FILTER (WHERE n <= 2) AS direct, count(*) FILTER (WHERE n > 2) AS detours, CAST(sum(waits) AS BIGINT) AS waits FROM h JOIN (SELECT trajectory, count(*) AS n, count(*) FILTER (WHERE x_end IS NOT NULL AND sqrt((x_end - x) ** 2 + (y_end - y) ** 2) <= 1e-9) AS waits FROM s GROUP BY trajectory) USING (trajectory) GROUP BY instrument")
def agg_03_plan_summary(spark, sf_dir):
    """Of a plane's plan: when it ends, direct paths, detours and waits."""
    way = views.waypoints(spark, sf_dir)
    w = W.partitionBy("trajectory").orderBy("seq")
    still = geometry.distance((F.col("x"), F.col("y")), (F.lead("x").over(w), F.lead("y").over(w))) <= lit(1e-9)
    each = way.select("trajectory", "instrument", "arrival", still.alias("still")).groupBy("trajectory", "instrument").agg(F.count("*").alias("n"), F.max("arrival").alias("last"), F.count_if("still").alias("waits"))
    return each.groupBy("instrument").agg(F.max("last").alias("makespan"), F.count_if(F.col("n") <= 2).alias("direct"), F.count_if(F.col("n") > 2).alias("detours"), F.sum("waits").alias("waits"))


@query(with_views("atoms") + " SELECT a.atom_id AS a_id, b.atom_id AS b_id, a.movable AS a_movable, b.movable AS b_movable, " + R("2e0 + 3e0 * (a.sigma + b.sigma) + 5e-1") + " AS safe FROM atoms a JOIN atoms b ON a.atom_id < b.atom_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 2e0 + 3e0 * (a.sigma + b.sigma) + 5e-1 - 1e-9")
def join_04_unsafe_atoms(spark, sf_dir):
    """Pairs of atoms, movable or not, nearer than the safe separation that both uncertainties ask for."""
    atoms = views.atoms(spark, sf_dir)
    widest = 2.5 + 6.0 * float(atoms.agg(F.coalesce(F.max("sigma"), lit(0))).first()[0])
    near = joins.near_pairs(atoms, atoms, "atom_id", "atom_id", widest, same=True)
    ends = lambda s: atoms.select(F.col("atom_id").alias(f"{s}_id"), F.col("movable").alias(f"{s}_movable"), F.col("sigma").alias(f"{s}_sigma"))
    both = near.join(ends("a"), "a_id").join(ends("b"), "b_id").withColumn("safe", lit(2) + lit(3) * (F.col("a_sigma") + F.col("b_sigma")) + lit(0.5))
    return both.where(F.col("distance") < F.col("safe") - lit(1e-9)).select("a_id", "b_id", "a_movable", "b_movable", r6("safe").alias("safe"))


@query(with_views("points") + " SELECT a.point_id AS a_id, b.point_id AS b_id FROM points a JOIN points b ON a.point_id < b.point_id AND abs(a.x - b.x) <= 3e0 AND abs(a.y - b.y) <= 2e0 WHERE ((a.x - b.x) / 3e0) ** 2 + ((a.y - b.y) / 2e0) ** 2 < 1")
def join_26_unresolved(spark, sf_dir):
    """Pairs nearer than one in units of each axis."""
    p = views.points(spark, sf_dir).select("point_id", (F.col("x") / lit(3)).alias("x"), (F.col("y") / lit(2)).alias("y"))
    return joins.near_pairs(p, p, "point_id", "point_id", 1.0, same=True).select("a_id", "b_id")


@query(with_views("points") + " SELECT point_id, CAST(row_number() OVER (ORDER BY y, x, point_id) AS BIGINT) AS trap_id FROM points")
def srt_10_canonical_order(spark, sf_dir):
    """Traps numbered from 1 by row, column and id."""
    placed = order.numbered(views.points(spark, sf_dir), ["y", "x", "point_id"])
    return placed.select("point_id", (F.col("number") + 1).alias("trap_id"))


@query(with_views("raster") + ", b AS (SELECT raster.* FROM raster, (SELECT floor(avg(level)) + 3 AS t FROM raster) WHERE level >= t) SELECT CAST(greatest(0, min(px) - 2) AS INTEGER) AS x_low, CAST(least(63, max(px) + 2) AS INTEGER) AS x_high, CAST(greatest(0, min(py) - 2) AS INTEGER) AS y_low, CAST(least(63, max(py) + 2) AS INTEGER) AS y_high FROM b")
def agg_08_padded_bounds(spark, sf_dir):
    """Bounds of the bright pixels with two pixels around, inside the image; nulls without any."""
    image = views.raster(spark, sf_dir)
    level = image.agg((F.floor(F.avg("level")) + 3).alias("t"))
    bright = image.crossJoin(F.broadcast(level)).where(F.col("level") >= F.col("t"))
    return bright.agg(F.greatest(F.lit(0), F.min("px") - 2).alias("x_low"), F.least(F.lit(63), F.max("px") + 2).alias("x_high"), F.greatest(F.lit(0), F.min("py") - 2).alias("y_low"), F.least(F.lit(63), F.max("py") + 2).alias("y_high"))


@query()
def srt_03_adaptive_bins(spark, sf_dir):
    """Bins of bright pixels, widened until there are few enough."""
    image = views.raster(spark, sf_dir)
    threshold = int(image.agg(F.floor(F.avg("level")) + 3).first()[0])
    return rasters.adaptive_bins(rasters.bright(image, threshold), 2, 60).select("spacing", "cy", "cx", "area", "total")


@query("WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_id AS key, CAST(1 AS BIGINT) AS id, k AS x, 1e0 AS y, 5e-1 AS phase, 1e0 AS intensity, TRUE AS ok FROM e UNION ALL SELECT event_id, 9, -2e0, k, k / 1e2, k - 1e1, k > 10 FROM e")
def src_03_tweezers(spark, sf_dir):
    """Lists of tweezers: tuples and objects with their aliases; ok if numbers are there and light is on."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"tweezers": [['), k, F.lit(', 1, 0.5], {"id": 9, "x": -2, "yUm": '), k, F.lit(', "phaseRad": '), (k.cast("double") / 100).cast("string"), F.lit(', "intensity": '), (k.cast("double") - 10).cast("string"), F.lit("}]}"))
    return points.tweezers(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), text.alias("text")), "key", "text")


@query("SELECT vec_id, CAST(64 AS BIGINT) AS bytes, sha256(unhex(array_to_string(list_transform(embedding, lambda v: printf('%02x', CAST(floor(least(greatest(CAST(v AS DOUBLE), -1e0), 1e0) * 127e0 + 128e0) AS BIGINT))), ''))) AS digest FROM embeddings")
def snk_10_raw_frames(spark, sf_dir):
    """Frames of codes as raw bytes."""
    code = lambda v: F.lpad(F.hex(F.floor(F.least(F.greatest(v.cast("double"), lit(-1)), lit(1)) * lit(127) + lit(128)).cast("long")), 2, "0")
    content = F.unhex(F.array_join(F.transform("embedding", code), ""))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("digest"))


@query(with_views("frames") + """ SELECT frame, '{"frame":' || frame || ',"least":' || CAST(floor(min(intensity)) AS BIGINT) || ',"traps":' || count(*) || '}' AS line FROM frames GROUP BY frame""")
def snk_09_manifest_lines(spark, sf_dir):
    """One line of JSON for the metrics of each frame, keys sorted."""
    f = views.trap_frames(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"), F.floor(F.min("intensity")).cast("long").alias("lo"))
    return f.select("frame", tables.canonical({"traps": F.col("n"), "least": F.col("lo"), "frame": F.col("frame")}).alias("line"))


@query(with_views("atoms", "targets") + ", e AS (SELECT least(0, min(x)) AS x0, greatest(0, max(y)) AS y1 FROM (SELECT x, y FROM atoms UNION ALL SELECT x, y FROM targets)), n AS (SELECT greatest(1, (SELECT count(*) FROM atoms WHERE movable) - (SELECT count(*) FROM targets WHERE required)) AS n) SELECT CAST(k AS BIGINT) AS k, " + R("least(6e1, greatest(-5e0, x0 + k * 4e0))") + " AS x, " + R("least(9e0, greatest(-5e0, y1 + 4e0))") + " AS y FROM e, n, LATERAL (SELECT unnest(range(0, n)) AS k)")
def gen_03_automatic_parking(spark, sf_dir):
    """Parking sites above all points, a gap apart, kept inside the field of view."""
    atoms, sites = views.atoms(spark, sf_dir), views.targets(spark, sf_dir)
    edge = atoms.select("x", "y").unionByName(sites.select("x", "y")).agg(F.least(lit(0), F.min("x")).alias("x0"), F.greatest(lit(0), F.max("y")).alias("y1"))
    need = atoms.agg(F.count_if("movable").alias("m")).crossJoin(sites.agg(F.count_if("required").alias("r"))).select(F.greatest(F.lit(1).cast("long"), F.col("m") - F.col("r")).alias("n"))
    k = edge.crossJoin(need).select("x0", "y1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    inside = lambda v, lo, hi: F.least(lit(hi), F.greatest(lit(lo), v))
    return k.select("k", r6(inside(F.col("x0") + F.col("k") * lit(4), -5, 60)).alias("x"), r6(inside(F.col("y1") + lit(4), -5, 9)).alias("y"))
