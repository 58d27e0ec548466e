"""Regions, clearances, conflicts between paths, lattices, selections along paths."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions import geometry, motion
from lumenloom.functions.numeric import lit
from lumenloom.operators import clearances, conflicts, graphs, joins, paths, selection
from lumenloom.plans import views
from lumenloom.plans.catalog import R, query, r6
from lumenloom.plans.views import table, with_views

SEGMENTS = """, s AS (SELECT * FROM (SELECT *, lead(x) OVER w AS x_end, lead(y) OVER w AS y_end, lead(arrival) OVER w AS arrival_end FROM waypoints WINDOW w AS (PARTITION BY trajectory ORDER BY seq)) WHERE arrival_end IS NOT NULL)"""
#: A polygon of the plane: corners in order.
CORNERS = ((10.0, 10.0), (90.0, 20.0), (60.0, 50.0), (20.0, 40.0))


def _to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Distance of a point and a segment in SQL."""
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    t = f"CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN greatest(0e0, least(1e0, ((({px}) - ({ax})) * {dx} + (({py}) - ({ay})) * {dy}) / ({dx} * {dx} + {dy} * {dy}))) ELSE 0e0 END"
    return f"sqrt((({px}) - (({ax}) + {dx} * ({t}))) ** 2 + (({py}) - (({ay}) + {dy} * ({t}))) ** 2)"


def _cross(a: str, b: str, c: str, d: str) -> str:
    """Whether two segments share a point, in SQL; arguments: 'x, y' pairs."""
    p = {k: v.split(", ") for k, v in zip("abcd", (a, b, c, d))}
    o = lambda i, j, k: f"((({p[j][0]}) - ({p[i][0]})) * (({p[k][1]}) - ({p[i][1]})) - (({p[j][1]}) - ({p[i][1]})) * (({p[k][0]}) - ({p[i][0]})))"
    on = lambda i, j, k: f"(abs({o(i, j, k)}) <= 1e-10 AND ({p[k][0]}) BETWEEN least({p[i][0]}, {p[j][0]}) - 1e-10 AND greatest({p[i][0]}, {p[j][0]}) + 1e-10 AND ({p[k][1]}) BETWEEN least({p[i][1]}, {p[j][1]}) - 1e-10 AND greatest({p[i][1]}, {p[j][1]}) + 1e-10)"
    return f"(({o('a', 'b', 'c')} * {o('a', 'b', 'd')} < 0 AND {o('c', 'd', 'a')} * {o('c', 'd', 'b')} < 0) OR {on('a', 'b', 'c')} OR {on('a', 'b', 'd')} OR {on('c', 'd', 'a')} OR {on('c', 'd', 'b')})"


def _between(a: str, b: str, c: str, d: str) -> str:
    """Distance of two segments in SQL."""
    q = [v.split(", ") for v in (a, b, c, d)]
    ends = [_to_segment(*q[0], *q[2], *q[3]), _to_segment(*q[1], *q[2], *q[3]), _to_segment(*q[2], *q[0], *q[1]), _to_segment(*q[3], *q[0], *q[1])]
    return f"CASE WHEN {_cross(a, b, c, d)} THEN 0e0 ELSE least({', '.join(ends)}) END"


def _edges() -> list[tuple[tuple[float, float], tuple[float, float]]]:
    return list(zip(CORNERS, (*CORNERS[1:], CORNERS[0])))


def _number(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


EDGE_DISTANCES = "least(" + ", ".join(_to_segment("x", "y", *map(_number, (*a, *b))) for a, b in _edges()) + ")"
INSIDE = "((" + " + ".join(f"CASE WHEN ({_number(a[1])} > y) <> ({_number(b[1])} > y) AND x < {_number(a[0])} + ({_number(b[0])} - {_number(a[0])}) * ((y - {_number(a[1])}) / ({_number(b[1])} - {_number(a[1])})) THEN 1 ELSE 0 END" for a, b in _edges()) + f") % 2 = 1 OR {EDGE_DISTANCES} <= 1e-10)"


@query(with_views("waypoints") + f" SELECT trajectory, seq, {R(f'CASE WHEN {INSIDE} THEN 0e0 ELSE {EDGE_DISTANCES} END')} AS distance, CASE WHEN {INSIDE} THEN 0e0 ELSE {EDGE_DISTANCES} END <= 3e0 AS forbidden FROM waypoints")
def sca_22_polygon_distance(spark, sf_dir):
    """Distance of waypoints to a polygon, 0 inside, and whether they are within its clearance."""
    polygon = [(lit(x), lit(y)) for x, y in CORNERS]
    d = geometry.to_polygon((F.col("x"), F.col("y")), polygon)
    return views.waypoints(spark, sf_dir).select("trajectory", "seq", r6(d).alias("distance"), (d <= lit(3)).alias("forbidden"))


EDGE_HITS = " OR ".join(f"{_between('x, y', 'x_end, y_end', ', '.join(map(_number, a)), ', '.join(map(_number, b)))} <= 2e0" for a, b in _edges())
ENDS_IN = f"({INSIDE}) OR ({INSIDE.replace('x <', 'x_end <').replace('> y)', '> y_end)').replace('((y -', '((y_end -').replace('((x) -', '((x_end) -').replace('((y) -', '((y_end) -')})"


@query(with_views("waypoints") + SEGMENTS + f", h AS (SELECT trajectory, seq, {_to_segment('5e1', '7e1', 'x', 'y', 'x_end', 'y_end')} <= 8e0 AS in_circle, {ENDS_IN} OR {EDGE_HITS} AS in_polygon FROM s) SELECT trajectory, count(*) AS n_segments, count(*) FILTER (WHERE in_circle) AS n_circle, count(*) FILTER (WHERE in_polygon) AS n_polygon, bool_or(in_circle OR in_polygon) AS blocked FROM h GROUP BY trajectory")
def sca_24_paths_in_regions(spark, sf_dir):
    """Segments of every path that hit a circle or a polygon with clearance, and whether any does."""
    s = joins.segments(views.waypoints(spark, sf_dir))
    a, b = (F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end"))
    circle = geometry.point_to_segment((lit(50), lit(70)), a, b) <= lit(8)
    polygon = geometry.segment_in_polygon(a, b, [(lit(x), lit(y)) for x, y in CORNERS], lit(2))
    h = s.select("trajectory", circle.alias("in_circle"), polygon.alias("in_polygon"))
    return h.groupBy("trajectory").agg(F.count("*").alias("n_segments"), F.count_if("in_circle").alias("n_circle"), F.count_if("in_polygon").alias("n_polygon"), F.bool_or(F.col("in_circle") | F.col("in_polygon")).alias("blocked"))


@query(f"SELECT p_partkey, CAST(i AS INTEGER) AS corner, {R('p_size + cos(i / 32e0 * 2e0 * pi()) * 2e0')} AS x, {R('1e0 + sin(i / 32e0 * 2e0 * pi()) * 2e0')} AS y FROM part, (SELECT unnest(range(0, 32)) AS i) WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, CAST(i AS INTEGER), CASE WHEN i IN (0, 3) THEN 0e0 ELSE p_size * 1e0 END, CASE WHEN i < 2 THEN 0e0 ELSE 5e0 END FROM part, (SELECT unnest(range(0, 4)) AS i) WHERE p_partkey % 2 = 1")
def sca_21_region_corners(spark, sf_dir):
    """Circles as 32 corners, boxes as 4."""
    n = F.col("p_size").cast("double")
    corners = F.when(F.col("p_partkey") % 2 == 0, geometry.circle_corners((n, lit(1)), lit(2))).otherwise(geometry.box_corners((lit(0), lit(0)), (n, lit(5))))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(corners).alias("corner", "c")).select("p_partkey", "corner", r6("c.x").alias("x"), r6("c.y").alias("y"))


@query(with_views("waypoints", "atoms") + SEGMENTS + f", t AS (SELECT s.trajectory, s.seq, min({_to_segment('a.x', 'a.y', 's.x', 's.y', 's.x_end', 's.y_end')}) AS d FROM s, atoms a WHERE NOT a.movable GROUP BY s.trajectory, s.seq) SELECT trajectory, count(*) FILTER (WHERE d < 15e-1 - 1e-9) AS n_touching, count(*) FILTER (WHERE d < 15e-1 - 1e-9) = 0 AS clear FROM t GROUP BY trajectory")
def join_14_static_clearance(spark, sf_dir):
    """Segments of a path nearer to a static atom than the clearance; segments and atoms meet on cells."""
    s = joins.segments(views.waypoints(spark, sf_dir))
    fixed = views.atoms(spark, sf_dir).where("not movable").select("x", "y")
    hit = joins.segments_near(s, fixed, ["trajectory", "seq"], 1.5)
    return s.select("trajectory", "seq").join(hit.withColumn("hit", F.lit(True)), ["trajectory", "seq"], "left").groupBy("trajectory").agg(F.count("hit").alias("n_touching"), (F.count("hit") == 0).alias("clear"))


#: Every path at every tick, its last place kept to the end; all pairs whose boxes come near.
CONFLICTS = with_views("waypoints", "ways") + f""", m AS (SELECT greatest(1, max(tick)) AS top FROM ways), n AS (SELECT trajectory, max(tick) AS last FROM ways GROUP BY trajectory),
    g AS (SELECT trajectory, last, unnest(range(0, CAST(top AS BIGINT))) AS t FROM n, m),
    s AS (SELECT g.trajectory, g.t, a.sigma, a.x, a.y, b.x AS x_end, b.y AS y_end FROM g JOIN ways a ON a.trajectory = g.trajectory AND a.tick = least(g.t, g.last) JOIN ways b ON b.trajectory = g.trajectory AND b.tick = least(g.t + 1, g.last)),
    q AS (SELECT a.trajectory AS a_id, b.trajectory AS b_id, a.t, 2e0 + 5e-1 * (a.sigma + b.sigma) AS safe, a.x AS ax, a.y AS ay, a.x_end AS bx, a.y_end AS by_, b.x AS cx, b.y AS cy, b.x_end AS dx, b.y_end AS dy FROM s a JOIN s b ON a.t = b.t AND b.trajectory > a.trajectory
        AND greatest(a.x, a.x_end) + 3 > least(b.x, b.x_end) AND greatest(b.x, b.x_end) + 3 > least(a.x, a.x_end) AND greatest(a.y, a.y_end) + 3 > least(b.y, b.y_end) AND greatest(b.y, b.y_end) + 3 > least(a.y, a.y_end)),
    k AS (SELECT *, CASE WHEN sqrt((ax - cx) ** 2 + (ay - cy) ** 2) < safe - 1e-9 THEN 'vertex' WHEN sqrt((ax - dx) ** 2 + (ay - dy) ** 2) < safe - 1e-9 AND sqrt((bx - cx) ** 2 + (by_ - cy) ** 2) < safe - 1e-9 THEN 'edge' WHEN {_between('ax, ay', 'bx, by_', 'cx, cy', 'dx, dy')} < safe - 1e-9 THEN 'near-edge' END AS kind FROM q),
    f AS (SELECT a_id, b_id, CAST(min(t) AS INTEGER) AS tick, arg_min(kind, t) AS kind FROM k WHERE kind IS NOT NULL GROUP BY a_id, b_id)"""


def _conflicts(spark, sf_dir):
    return conflicts.conflicts(views.ways(spark, sf_dir), minimum=1.5, margin=0.5, sigmas=0.5)


@query(CONFLICTS + " SELECT a_id, b_id, tick, kind FROM f")
def join_12_conflict_kinds(spark, sf_dir):
    """First tick at which two paths come nearer than their safe separation, and how: at a vertex, by
    changing places, or between."""
    return _conflicts(spark, sf_dir)


@query("WITH RECURSIVE " + CONFLICTS.removeprefix("WITH ") + ", e AS (SELECT a_id AS p, b_id AS q FROM f UNION SELECT b_id, a_id FROM f), reach AS (SELECT p, p AS q FROM e UNION SELECT r.p, e.q FROM reach r JOIN e ON r.q = e.p), l AS (SELECT p, min(q) AS component FROM reach GROUP BY p) SELECT component, count(*) AS n_paths FROM l GROUP BY component")
def gen_05_conflict_components(spark, sf_dir):
    """Connected components of paths that conflict."""
    found = graphs.components(_conflicts(spark, sf_dir), "a_id", "b_id")
    return found.groupBy("component").agg(F.count("*").alias("n_paths"))


@query(with_views("waypoints") + SEGMENTS + ", l AS (SELECT trajectory, seq, sqrt((x_end - x) ** 2 + (y_end - y) ** 2) AS d FROM s) SELECT trajectory, seq, " + R("max(1875e-3 * d / 1e3) OVER w") + " AS speed, " + R("max(5774e-3 * d / 1e6) OVER w") + " AS acceleration, " + R("max(60e0 * d / 1e9) OVER w") + " AS jerk, " + R("d * 1875e-3 / 2e1") + " AS step_bound FROM l WINDOW w AS (PARTITION BY trajectory ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def agg_18_motion_maxima(spark, sf_dir):
    """Running maxima of speed, acceleration and jerk along a path; a bound of the step in a frame."""
    s = joins.segments(views.waypoints(spark, sf_dir))
    d = geometry.distance((F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end")))
    so_far = W.partitionBy("trajectory").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    top = lambda peak, power: r6(F.max(lit(peak) * d / lit(1000.0**power)).over(so_far))
    return s.select("trajectory", "seq", top(motion.PEAK_SPEED, 1).alias("speed"), top(motion.PEAK_ACCELERATION, 2).alias("acceleration"), top(motion.PEAK_JERK, 3).alias("jerk"), r6(d * lit(motion.PEAK_SPEED) / lit(20)).alias("step_bound"))


@query(with_views("waypoints") + SEGMENTS + ", l AS (SELECT trajectory, seq, sqrt((x_end - x) ** 2 + (y_end - y) ** 2) AS d FROM s), k AS (SELECT trajectory, seq, d, i / 8e0 AS t0, (i + 1) / 8e0 AS t1 FROM l, (SELECT unnest(range(0, 8)) AS i)) SELECT trajectory, seq, " + R("max(d * (t1 * t1 * t1 * (1e1 + t1 * (-15e0 + 6e0 * t1)) - t0 * t0 * t0 * (1e1 + t0 * (-15e0 + 6e0 * t0))))") + " AS largest FROM k GROUP BY trajectory, seq")
def agg_20_frame_steps(spark, sf_dir):
    """The largest step of a segment between two of its frames."""
    s = joins.segments(views.waypoints(spark, sf_dir))
    d = geometry.distance((F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end")))
    return s.select("trajectory", "seq", r6(motion.largest_step(d, F.lit(8))).alias("largest"))


@query(with_views("waypoints") + ", e AS (SELECT instrument, max(arrival) AS final FROM waypoints GROUP BY instrument), l AS (SELECT trajectory, any_value(instrument) AS instrument, max(arrival) AS arrival, arg_max(x, seq) AS x, arg_max(y, seq) AS y, max(seq) AS seq FROM waypoints GROUP BY trajectory) SELECT trajectory, CAST(seq + 1 AS INTEGER) AS seq, " + R("x") + " AS x, " + R("y") + " AS y, final AS arrival FROM l JOIN e USING (instrument) WHERE arrival < final")
def win_09_common_end(spark, sf_dir):
    """The waypoint that brings every path of a plane to the plane's last time."""
    way = views.waypoints(spark, sf_dir)
    return joins.common_end(way, "instrument").select("trajectory", "seq", r6("x").alias("x"), r6("y").alias("y"), "arrival")


@query(with_views("points") + ", xs AS (SELECT DISTINCT floor(x / 1e2) * 1e2 AS gx FROM points), ys AS (SELECT DISTINCT floor(y / 5e0) * 5e0 AS gy FROM points), b AS (SELECT DISTINCT gx, gy FROM xs, ys, points p WHERE (p.x - gx) ** 2 + (p.y - gy) ** 2 < 1e0) SELECT gx, gy FROM xs, ys EXCEPT SELECT gx, gy FROM b")
def gen_04_lattice(spark, sf_dir):
    """The nodes of a lattice on the points' coordinates that no point blocks."""
    p = views.points(spark, sf_dir)
    xs, ys = p.select((F.floor(F.col("x") / lit(100)) * lit(100)).alias("gx")).distinct(), p.select((F.floor(F.col("y") / lit(5)) * lit(5)).alias("gy")).distinct()
    # Nodes lie farther apart than twice the clearance, so a point can block the nearest one alone.
    nearest = lambda c, step: F.floor(F.col(c) / lit(step) + lit(0.5)) * lit(step)
    near = p.select("x", "y", nearest("x", 100).alias("gx"), nearest("y", 5).alias("gy"))
    blocked = near.where(geometry.distance((F.col("x"), F.col("y")), (F.col("gx"), F.col("gy"))) < lit(1)).select("gx", "gy").distinct()
    return xs.crossJoin(F.broadcast(ys)).join(blocked, ["gx", "gy"], "left_anti")


@query(with_views("points", "atoms") + f", n AS (SELECT * FROM points), e AS (SELECT a.point_id AS a_id, b.point_id AS b_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM n a JOIN n b ON a.point_id < b.point_id AND abs(a.x - b.x) < 45e-1 AND abs(a.y - b.y) < 45e-1 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 45e-1) SELECT a_id, b_id FROM e WHERE NOT EXISTS (SELECT 1 FROM atoms t WHERE NOT t.movable AND {_to_segment('t.x', 't.y', 'ax', 'ay', 'bx', 'by_')} < 5e-1 - 1e-9)")
def join_28_roadmap(spark, sf_dir):
    """Edges between all near nodes of a roadmap that keep clear of static atoms."""
    nodes = views.points(spark, sf_dir)
    fixed = views.atoms(spark, sf_dir).where("not movable").select("x", "y")
    ends = lambda s, x, y: nodes.select(F.col("point_id").alias(f"{s}_id"), F.col("x").alias(x), F.col("y").alias(y))
    edges = joins.near_pairs(nodes, nodes, "point_id", "point_id", 4.5, same=True).select("a_id", "b_id").join(ends("a", "x", "y"), "a_id").join(ends("b", "x_end", "y_end"), "b_id")
    return edges.join(joins.segments_near(edges, fixed, ["a_id", "b_id"], 0.5), ["a_id", "b_id"], "left_anti").select("a_id", "b_id")


@query(with_views("atoms", "targets") + f""", m AS (SELECT a.atom_id, a.x, a.y, t.x AS tx, t.y AS ty FROM atoms a JOIN targets t ON a.atom_id = t.site_id), w AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM atoms),
    b AS (SELECT m.*, least(x0, x, tx) - 85e-1 AS l, greatest(x1, x, tx) + 85e-1 AS r, least(y0, y, ty) - 85e-1 AS d, greatest(y1, y, ty) + 85e-1 AS u FROM m, w),
    c AS (SELECT *, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS k, unnest([l, l, r, r, (l + r) / 2, (l + r) / 2, l, r, (x + tx) / 2, (x + tx) / 2]) AS ox, unnest([d, u, d, u, d, u, (d + u) / 2, (d + u) / 2, (y + ty) / 2 + 4e0, (y + ty) / 2 - 4e0]) AS oy FROM b),
    n AS (SELECT *, {R('sqrt((x - ox) ** 2 + (y - oy) ** 2) + sqrt((ox - tx) ** 2 + (oy - ty) ** 2)')} AS length FROM c)
    SELECT atom_id, CAST(k AS INTEGER) AS k, {R('ox')} AS ox, {R('oy')} AS oy, length, CAST(row_number() OVER (PARTITION BY atom_id ORDER BY length, k) AS INTEGER) AS place FROM n""")
def srt_09_detours(spark, sf_dir):
    """All ten detour points of a move, ordered by the length of the way through them."""
    atoms, sites = views.atoms(spark, sf_dir), views.targets(spark, sf_dir)
    moves = atoms.select("atom_id", "x", "y").join(sites.select(F.col("site_id").alias("atom_id"), F.col("x").alias("tx"), F.col("y").alias("ty")), "atom_id")
    found = paths.detours(moves, "atom_id", atoms, separation=2.0, margin=0.5)
    return found.select("atom_id", "k", r6("ox").alias("ox"), r6("oy").alias("oy"), "length", "place")


@query()
def win_06_resampled(spark, sf_dir):
    """Paths as points at equal travelled distance."""
    return paths.resampled(views.waypoints(spark, sf_dir), "trajectory", 25.0)


@query()
def srt_04_resolvable(spark, sf_dir):
    """Of all waypoints of the plane the strongest that keep a least distance from all stronger ones kept."""
    way = views.ways(spark, sf_dir).withColumn("strength", F.pmod(F.xxhash64("trajectory", "seq"), F.lit(1000)))
    found = selection.apart(way.select("trajectory", "seq", "x", "y", "strength"), [F.desc("strength"), F.col("trajectory"), F.col("seq")], 2.0, 3.0)
    return found.select("trajectory", "seq", "strength", "place")


@query()
def srt_05_appended_points(spark, sf_dir):
    """Points appended in order to the fixed atoms, rounded, while they keep apart and there are few enough."""
    fixed = views.atoms(spark, sf_dir).where("not movable").select("x", "y")
    found = selection.apart(views.points(spark, sf_dir), [F.crc32(F.col("point_id").cast("string").cast("binary")), F.col("point_id")], 4.0, 4.0, digits=6, existing=fixed, at_most=2000)
    return found.select("point_id", "x", "y", "place")


@query()
def srt_06_merged_points(spark, sf_dir):
    """Of points within a tolerance the first stays; they come in the order of a hash of their ids."""
    p = views.points(spark, sf_dir)
    found = selection.apart(p, [F.crc32(F.col("point_id").cast("string").cast("binary")), F.col("point_id")], 3.2, 3.2, inclusive=True)
    return found.select("point_id", "place")


def _timed(way):
    """Waypoints that each path reaches at times of its own."""
    return way.withColumn("arrival", (F.col("seq") * 1000 + F.pmod(F.col("trajectory") * 7919 + F.col("seq") * 104729, F.lit(900))).cast("long"))


def _between_paths(t: str) -> str:
    """Distance of the two paths of a pair at time t, in SQL."""
    q = lambda s: f"((({t}) - {s}_start) / ({s}_stop - {s}_start))"
    at = lambda s, c: f"({s}_{c} + ({s}_{c}_end - {s}_{c}) * {q(s)} ** 3 * (10e0 + {q(s)} * (6e0 * {q(s)} - 15e0)))"
    return f"sqrt(({at('a', 'x')} - {at('b', 'x')}) ** 2 + ({at('a', 'y')} - {at('b', 'y')}) ** 2)"


PROOFS = (
    with_views("waypoints", "ways").replace("WITH", "WITH RECURSIVE", 1)
    + """, w AS (SELECT trajectory, seq, x, y, sigma, CAST(seq * 1000 + (trajectory * 7919 + seq * 104729) % 900 AS DOUBLE) AS start FROM ways),
    l AS (SELECT *, lead(start) OVER o AS stop, lead(x) OVER o AS x_end, lead(y) OVER o AS y_end, row_number() OVER o AS r FROM w WINDOW o AS (PARTITION BY trajectory ORDER BY seq)),
    m AS (SELECT *, max(start) OVER () AS top FROM l),
    s AS (SELECT *, 1875e-3 * sqrt((x_end - x) ** 2 + (y_end - y) ** 2) / (stop - start) AS speed FROM (SELECT trajectory, start, coalesce(stop, top) AS stop, x, y, coalesce(x_end, x) AS x_end, coalesce(y_end, y) AS y_end, sigma FROM m UNION ALL SELECT trajectory, 0e0, start, x, y, x, y, sigma FROM m WHERE r = 1) WHERE start < stop),
    p AS (SELECT """
    + ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in ("trajectory", "start", "stop", "x", "y", "x_end", "y_end"))
    + """, greatest(a.start, b.start) AS t0, least(a.stop, b.stop) AS t1, 6e-1 + 2e0 * (a.sigma + b.sigma) AS safe, a.speed + b.speed AS v FROM s a JOIN s b ON a.trajectory < b.trajectory AND a.start < b.stop AND b.start < a.stop
        AND greatest(a.x, a.x_end) + 3e0 > least(b.x, b.x_end) AND greatest(b.x, b.x_end) + 3e0 > least(a.x, a.x_end) AND greatest(a.y, a.y_end) + 3e0 > least(b.y, b.y_end) AND greatest(b.y, b.y_end) + 3e0 > least(a.y, a.y_end)),
    n AS (SELECT *, """
    + f"{_between_paths('lo')} AS d0, {_between_paths('(lo + hi) / 2e0')} AS d1, {_between_paths('hi')} AS d2"
    + """ FROM (SELECT *, t0 AS lo, t1 AS hi, 0 AS level FROM p) UNION ALL SELECT *, """
    + f"{_between_paths('lo')}, {_between_paths('(lo + hi) / 2e0')}, {_between_paths('hi')}"
    + """ FROM (SELECT n.* EXCLUDE (lo, hi, level, d0, d1, d2), CASE h WHEN 0 THEN lo ELSE (lo + hi) / 2e0 END AS lo, CASE h WHEN 0 THEN (lo + hi) / 2e0 ELSE hi END AS hi, level + 1 AS level FROM n, (VALUES (0), (1)) AS halves(h) WHERE least(d0, d1, d2) >= safe - 1e-9 AND hi - lo > 1e-9 AND d1 <= safe + v * (hi - lo) / 2e0 + 1e-9 AND level < 12)),
    f AS (SELECT a_trajectory, b_trajectory, t0, min(lo) AS bad FROM n WHERE least(d0, d1, d2) < safe - 1e-9 OR level = 12 AND hi - lo > 1e-9 AND d1 <= safe + v * (hi - lo) / 2e0 + 1e-9 GROUP BY 1, 2, 3),
    g AS (SELECT a_trajectory, b_trajectory, min(t0) AS t0, min_by(bad, t0) AS bad FROM f GROUP BY 1, 2)
    SELECT a_trajectory AS a_id, b_trajectory AS b_id, t0 AS start, any_value(t1) AS stop, """
    + R("min(least(d0, d1, d2))")
    + " AS least, "
    + R("any_value(safe)")
    + " AS safe FROM n JOIN g USING (a_trajectory, b_trajectory, t0) WHERE lo <= bad GROUP BY 1, 2, 3"
)


@query(PROOFS)
def join_19_proven_clearance(spark, sf_dir):
    """Pairs of paths of the plane that are not proven clear over time, with the first interval between
    breakpoints of both that isn't and the smallest distance met in it."""
    found = clearances.unproven(_timed(views.ways(spark, sf_dir)), minimum=0.5, margin=0.1, sigmas=2.0)
    return found.select("a_id", "b_id", "start", "stop", r6("least").alias("least"), r6("safe").alias("safe"))
