"""Relations between point sets: bucketed distance joins, cost matrices, as-of lookups."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions.geometry import Point, distance, distance_squared, point_to_segment, segments_cross
from lumenloom.functions.numeric import lerp, lit
from lumenloom.functions import motion
from lumenloom.operators.lineage import cut
from lumenloom.operators.order import numbered


#: A cell is so many reaches wide.
CELL = 4


def near_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, reach: float, *, same: bool = False) -> DataFrame:
    """(left_id, right_id, distance) of all pairs closer than reach, by an equi-join on grid cells.

    Each left point stands in its own cell, each right point in the cells within reach of it: mostly its
    own alone, as cells are wider than the reach, and some two on average. No pair is formed beyond
    neighbouring cells. same: both sides are one set, pairs come once, ids ascending.
    """
    cell = lambda c, more=0.0: F.floor((F.col(c) + lit(more)) / lit(CELL * reach)).cast("long")
    wide = reach * (1 + 1e-9)
    a = left.select(F.col(left_id).alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    spread = lambda c: F.sequence(cell(c, -wide), cell(c, wide))
    b = right.select(F.col(right_id).alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(spread("x")).alias("cx"), spread("y").alias("_ys")).select("b_id", "bx", "by", "cx", F.explode("_ys").alias("cy"))
    on = [a["cx"] == b["cx"], a["cy"] == b["cy"]] + ([a["a_id"] < b["b_id"]] if same else [])
    d = distance((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")))
    return a.join(b, on).select(F.col("a_id"), F.col("b_id"), d.alias("distance")).where(F.col("distance") < lit(reach))


def cost_matrix(atoms: DataFrame, targets: DataFrame, *, stay: float = 0.25, group_penalty: float = 4.0, distance_weight: float = 1.0) -> DataFrame:
    """Every movable atom with every required target: atom_id, site_id, cost, feasible.

    Targets are few (their number is set by the instrument) and are broadcast only if they are.
    """
    sites = targets.where("required").select("site_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("grp").alias("t_grp"))
    few = sites.limit(10_001).count() <= 10_000
    d2 = distance_squared((F.col("x"), F.col("y")), (F.col("tx"), F.col("ty")))
    base = lit(distance_weight) * d2 + F.when(F.col("grp") != F.col("t_grp"), lit(group_penalty)).otherwise(lit(0))
    cost = F.when(d2 <= lit(stay * stay), base * lit(0.001)).otherwise(base)
    return atoms.where("movable").crossJoin(F.broadcast(sites) if few else sites).select("atom_id", "site_id", cost.alias("cost"))


def cheapest_source(matrix: DataFrame) -> DataFrame:
    """For every site the atom of least cost, ties to the smaller id."""
    best = matrix.groupBy("site_id").agg(F.min(F.struct("cost", "atom_id")).alias("b"))
    return best.select("site_id", F.col("b.atom_id").alias("atom_id"), F.col("b.cost").alias("cost"))


def cheapest_nearby(atoms: DataFrame, targets: DataFrame, *, stay: float = 0.25, group_penalty: float = 4.0, reach: float = 8.0) -> DataFrame:
    """As cheapest_source of the cost matrix, without the matrix: (site_id, atom_id, cost).

    The nearest atom costs at most its squared distance and the penalty, so no atom farther than the
    root of that can be cheaper. Sites and atoms meet on grid cells; sites whose bound is beyond the
    cells' reach go on with twice the reach.
    """
    sites = targets.where("required").select("site_id", "x", "y", F.col("grp").alias("t_grp"))
    movable = atoms.where("movable").select("atom_id", "x", "y", "grp")
    extent = movable.select("x", "y").unionAll(sites.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    widest = max(extent[0] or 0.0, extent[1] or 0.0) * 2
    done, left = None, sites
    while True:
        near = near_pairs(left, movable, "site_id", "atom_id", reach).withColumnsRenamed({"a_id": "site_id", "b_id": "atom_id"})
        pairs = near.join(left.select("site_id", "t_grp", F.col("x").alias("tx"), F.col("y").alias("ty")), "site_id").join(movable, "atom_id")
        d2 = distance_squared((F.col("x"), F.col("y")), (F.col("tx"), F.col("ty")))
        base = d2 + F.when(F.col("grp") != F.col("t_grp"), lit(group_penalty)).otherwise(lit(0))
        cost = F.when(d2 <= lit(stay * stay), base * lit(0.001)).otherwise(base)
        best = pairs.groupBy("site_id").agg(F.min(d2).alias("d2"), F.min(F.struct(cost.alias("cost"), "atom_id")).alias("b"))
        best = cut(best.where(F.lit(reach > widest) | (F.col("d2") + lit(group_penalty) <= lit(reach * reach))).select("site_id", F.col("b.atom_id").alias("atom_id"), F.col("b.cost").alias("cost")))
        done = best if done is None else done.unionByName(best)
        if reach > widest:
            return done
        left = cut(left.join(best.select("site_id"), "site_id", "left_anti"))
        if left.limit(1).count() == 0:
            return done
        reach *= 2


def segments(waypoints: DataFrame) -> DataFrame:
    """Consecutive waypoints of a trajectory as segments with start and end."""
    order = W.partitionBy("trajectory").orderBy("seq")
    ends = [F.lead(c).over(order).alias(f"{c}_end") for c in ("x", "y", "arrival")]
    return waypoints.select("*", *ends).where("arrival_end is not null")


def crossings(parts: DataFrame, cell: float = 10.0) -> DataFrame:
    """(a_id, b_id, first_conflict, n_conflicts) of all pairs of trajectories with segments of the same seq
    that share a point; parts: trajectory, seq, x, y, x_end, y_end.

    Segments meet in the grid cells that their bounding boxes have in common, and a pair is taken
    in the lowest of these only, so that it comes once.
    """
    edge = lambda pick, c, more: F.floor((pick(c, f"{c}_end") + lit(more)) / lit(cell)).cast("long")
    low = {c: edge(F.least, c, -1e-9) for c in "xy"}
    high = {c: edge(F.greatest, c, 1e-9) for c in "xy"}
    s = parts.select("trajectory", "seq", "x", "y", "x_end", "y_end", low["x"].alias("lx"), low["y"].alias("ly"), F.explode(F.sequence(low["x"], high["x"])).alias("cx"), F.sequence(low["y"], high["y"]).alias("cys"))
    s = s.select("*", F.explode("cys").alias("cy")).drop("cys")
    o = s.select("seq", "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("trajectory", "x", "y", "x_end", "y_end", "lx", "ly")])
    lowest = (F.col("cx") == F.greatest("lx", "o_lx")) & (F.col("cy") == F.greatest("ly", "o_ly"))
    at = lambda p, e="": (F.col(f"{p}x{e}"), F.col(f"{p}y{e}"))
    hit = segments_cross(at(""), at("", "_end"), at("o_"), at("o_", "_end"))
    pairs = s.join(o, ["seq", "cx", "cy"]).where((F.col("trajectory") < F.col("o_trajectory")) & lowest).where(hit)
    return pairs.groupBy(F.col("trajectory").alias("a_id"), F.col("o_trajectory").alias("b_id")).agg(F.min("seq").alias("first_conflict"), F.count("*").alias("n_conflicts"))


def last_before(parts: DataFrame, times: DataFrame, time: str, columns: list[str], inclusive: bool) -> DataFrame:
    """(trajectory, time, part): the last of the parts that begin before each time, or at it."""
    given = parts.select("trajectory", F.col("arrival").alias("_t"), F.lit(0 if inclusive else 1).alias("_rank"), F.struct(*columns).alias("part"))
    asked = times.select("trajectory", F.col(time).alias("_t"), F.lit(1 if inclusive else 0).alias("_rank"), F.lit(None).cast(given.schema["part"].dataType).alias("part"))
    order = W.partitionBy("trajectory").orderBy("_t", "_rank", F.col("part.seq")).rowsBetween(W.unboundedPreceding, 0)
    found = given.unionByName(asked).select("trajectory", "_t", "_rank", F.last("part", ignorenulls=True).over(order).alias("part"))
    return found.where(F.col("_rank") == (1 if inclusive else 0)).select("trajectory", F.col("_t").alias(time), "part")


def sample_at(waypoints: DataFrame, times: DataFrame, time: str = "t") -> DataFrame:
    """Position of every trajectory at the given times by minimum-jerk motion.

    A time equal to a waypoint belongs to the earlier segment: start < t <= end. times has the
    columns trajectory and `time`. Segments and times are one ordered stream for each trajectory.
    """
    columns = ["seq", "x", "y", "arrival", "x_end", "y_end", "arrival_end"]
    found = last_before(segments(waypoints), times, time, columns, inclusive=False).select("trajectory", time, "part.*").where(F.col(time) <= F.col("arrival_end"))
    q = motion.progress((F.col(time) - F.col("arrival")) / (F.col("arrival_end") - F.col("arrival")))
    return found.select("trajectory", time, lerp(F.col("x"), F.col("x_end"), q).alias("x"), lerp(F.col("y"), F.col("y_end"), q).alias("y"))


def free_ids(wanted: DataFrame, taken: DataFrame, key: str, other: str) -> DataFrame:
    """key -> id: the key itself unless taken, else the next free number above all, in key order."""
    used = taken.select(F.col(other).alias(key)).distinct()
    highest = wanted.select(F.col(key).alias("v")).union(taken.select(F.col(other).alias("v"))).agg(F.coalesce(F.max("v"), F.lit(0)).alias("top"))
    kept = wanted.join(used, key, "left_anti").select(key, F.col(key).alias("trap_id"))
    moved = wanted.join(used, key, "left_semi").crossJoin(F.broadcast(highest))
    placed = numbered(moved, [key]).select(key, (F.col("top") + 1 + F.col("number")).alias("trap_id"))
    return kept.union(placed)


def lookup(code: Column, pairs: list[tuple[int, float]]) -> Column:
    """Piecewise-linear value of a code among (code, value) pairs."""
    (_, first), value = pairs[0], None
    for (c0, v0), (c1, v1) in zip(pairs, pairs[1:]):
        part = lerp(lit(v0), lit(v1), (code - lit(c0)) / lit(c1 - c0))
        value = F.when(code <= c1, part) if value is None else value.when(code <= c1, part)
    return value.otherwise(lit(pairs[-1][1])) if value is not None else lit(first)


def step_at(waypoints: DataFrame, times: DataFrame, time: str = "t") -> DataFrame:
    """Last waypoint at or before each time, the first for earlier times; with the point between it
    and the next on a straight line."""
    order = W.partitionBy("trajectory").orderBy("seq")
    ends = [F.lead(c).over(order).alias(f"{c}_end") for c in ("x", "y", "arrival")]
    parts = waypoints.select("*", *ends)
    columns = ["seq", "x", "y", "arrival", "x_end", "y_end", "arrival_end"]
    first = parts.groupBy("trajectory").agg(F.min_by(F.struct(*columns), "seq").alias("first"))
    found = last_before(parts, times, time, columns, inclusive=True).join(first, "trajectory").select("trajectory", time, F.coalesce("part", "first").alias("part")).select("trajectory", time, "part.*")
    share = F.when(F.col("arrival_end").isNull() | (F.col(time) < F.col("arrival")), lit(0)).otherwise(F.try_divide(F.col(time) - F.col("arrival"), F.col("arrival_end") - F.col("arrival")))
    at = [F.when(F.col(f"{c}_end").isNull(), F.col(c)).otherwise(lerp(F.col(c), F.col(f"{c}_end"), share)).alias(c) for c in ("x", "y")]
    return found.select("trajectory", time, "seq", *at)


def scatter(points: DataFrame, value: str) -> DataFrame:
    """Values spread over the four cells around each point, by nearness: (cy, cx, total)."""
    x0, y0 = F.floor("x").cast("long"), F.floor("y").cast("long")
    fx, fy = F.col("x") - x0, F.col("y") - y0
    cells = F.array(*[F.struct((y0 + j).alias("cy"), (x0 + i).alias("cx"), (F.col(value) * (fx if i else lit(1) - fx) * (fy if j else lit(1) - fy)).alias("part")) for j in (0, 1) for i in (0, 1)])
    return points.select(F.explode(cells).alias("c")).groupBy("c.cy", "c.cx").agg(F.sum("c.part").alias("total"))


def segments_near(parts: DataFrame, points: DataFrame, key: list[str], reach: float) -> DataFrame:
    """The keys of segments (x, y, x_end, y_end) nearer than reach to any of the points (x, y).

    A segment stands in the cells of its bounding box, widened by reach; a point in its own cell.
    """
    size = lit(max(reach * 4, 1e-9))
    low = {c: F.floor((F.least(c, f"{c}_end") - lit(reach)) / size).cast("long") for c in "xy"}
    high = {c: F.floor((F.greatest(c, f"{c}_end") + lit(reach)) / size).cast("long") for c in "xy"}
    s = parts.select(*key, "x", "y", "x_end", "y_end", F.explode(F.sequence(low["x"], high["x"])).alias("cx"), F.sequence(low["y"], high["y"]).alias("cys"))
    s = s.select("*", F.explode("cys").alias("cy")).drop("cys")
    p = points.select(F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / size).cast("long").alias("cx"), F.floor(F.col("y") / size).cast("long").alias("cy"))
    d = point_to_segment((F.col("px"), F.col("py")), (F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end")))
    return s.join(p, ["cx", "cy"]).where(d < lit(reach - 1e-9)).select(*key).distinct()


def fans_near(parts: DataFrame, ends: DataFrame, points: DataFrame, key: list[str], end: str, reach: float) -> DataFrame:
    """As segments_near, for segments of any length that lead to a few common ends (`end`, x_end, y_end).

    Seen from its end, a point nearer than reach to a segment lies at most reach beyond its start, and in
    its direction by an angle whose sine is reach over the point's distance. So points stand in rings about
    each end, each four times as wide as the one within, and in the sectors of their ring that their angle
    touches; a segment asks one sector of every ring up to its start. A sector is about reach wide, whatever
    the length, and the first point found near ends the search of a segment in a ring.
    """
    inner = 16 * max(reach, 1e-9)
    ring = lambda d: F.greatest(F.lit(0), F.ceil(F.log(F.greatest(d, lit(inner)) / lit(inner)) / lit(math.log(4)))).cast("int")
    # Ring 0 has one sector; ring k begins at inner * 4^(k - 1), where a point's angle is widest.
    count = lambda k: F.when(k == 0, lit(1)).otherwise(F.floor(lit(math.pi * inner / (4 * max(reach, 1e-9))) * F.pow(lit(4), k)))
    turn = lambda dx, dy: (F.atan2(dy, dx) + lit(math.pi)) / lit(2 * math.pi)
    dx, dy = F.col("px") - F.col("x_end"), F.col("py") - F.col("y_end")
    far = F.hypot(dx, dy)
    seen = points.select(F.col("x").alias("px"), F.col("y").alias("py")).where("px is not null and py is not null").crossJoin(F.broadcast(ends.select(end, "x_end", "y_end")))
    seen = seen.select(F.col(end).alias("o"), "px", "py", far.alias("far"), turn(dx, dy).alias("at")).withColumn("ring", ring(F.col("far") * lit(1 - 1e-9))).withColumn("n", count(F.col("ring")))
    wide = F.asin(F.least(lit(1), lit(reach) / F.greatest("far", lit(1e-9)))) / lit(2 * math.pi) + lit(1e-9)
    sectors = F.sequence(F.floor((F.col("at") - wide) * F.col("n")).cast("long"), F.floor((F.col("at") + wide) * F.col("n")).cast("long"))
    sectors = F.when(F.col("ring") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform(sectors, lambda v: F.pmod(v, F.col("n").cast("long")))))
    seen = seen.select("o", "px", "py", "ring", F.explode(sectors).alias("sector"))
    start = F.hypot(F.col("x") - F.col("x_end"), F.col("y") - F.col("y_end")) + lit(reach)
    asked = parts.select(*key, F.col(end).alias("o"), "x", "y", "x_end", "y_end", turn(F.col("x") - F.col("x_end"), F.col("y") - F.col("y_end")).alias("at"), F.explode(F.sequence(F.lit(0), ring(start * lit(1 + 1e-9)))).alias("ring"))
    asked = asked.withColumn("sector", F.pmod(F.floor(F.col("at") * count(F.col("ring"))), count(F.col("ring"))).cast("long"))
    d = point_to_segment((F.col("px"), F.col("py")), (F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end")))
    same = [asked[c] == seen[c] for c in ("o", "ring", "sector")]
    return asked.join(seen, [*same, d < lit(reach - 1e-9)], "left_semi").select(*key).distinct()


def common_end(waypoints: DataFrame, plane: str) -> DataFrame:
    """(trajectory, seq, x, y, arrival): one more waypoint for each path that ends before its plane."""
    last = waypoints.groupBy("trajectory", plane).agg(F.max(F.struct("seq", "x", "y", "arrival")).alias("l"))
    final = waypoints.groupBy(plane).agg(F.max("arrival").alias("final"))
    return last.join(final, plane).where("l.arrival < final").select("trajectory", (F.col("l.seq") + 1).alias("seq"), "l.x", "l.y", F.col("final").alias("arrival"))


#: Fixed value: the cost of an edge that is not allowed.
FORBIDDEN = 1e30


def edge_costs(atoms: DataFrame, sites: DataFrame, fixed: DataFrame, penalties: DataFrame, blocked: Callable[[Point, Point], Column], *, stay: float = 0.25, obstacle: float = 1000.0, static: float = 100.0, mismatch: float = 1000.0) -> DataFrame:
    """(atom_id, site_id, feasible, cost) of all edges.

    sites: site_id, x, y, required_atom and required_group (-1: any), forbid (a wrong group is not
    allowed rather than dear). blocked: whether a straight way meets an obstacle. Ways near a fixed
    point meet it in sectors about their site; penalties (atom_id, site_id, penalty) join by key. Forbidden edges
    cost 1e30. A little of both ids keeps the order of equal costs.
    """
    wanted = sites.select("site_id", F.col("x").alias("x_end"), F.col("y").alias("y_end"), "required_atom", "required_group", "forbid")
    few = wanted.limit(10_001).count() <= 10_000
    e = atoms.select("atom_id", "x", "y", "grp").crossJoin(F.broadcast(wanted) if few else wanted)
    hit = (fans_near(e, wanted, fixed, ["atom_id", "site_id"], "site_id", stay) if few else segments_near(e, fixed, ["atom_id", "site_id"], stay)).withColumn("hit", F.lit(True))
    e = e.join(hit, ["atom_id", "site_id"], "left").join(penalties, ["atom_id", "site_id"], "left")
    a, b = (F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end"))
    other = (F.col("required_group") != -1) & (F.col("required_group") != F.col("grp"))
    feasible = ~((F.col("required_atom") != -1) & (F.col("required_atom") != F.col("atom_id"))) & ~(other & F.col("forbid"))
    extra = lambda when, much: F.when(when, lit(much)).otherwise(lit(0))
    cost = distance_squared(a, b) + extra(blocked(a, b), obstacle) + extra(F.col("hit").isNotNull(), static) + extra(other, mismatch)
    cost = cost * F.when(distance(a, b) <= lit(stay), lit(0.001)).otherwise(lit(1)) + F.coalesce("penalty", lit(0))
    cost = cost + F.col("atom_id") * lit(1e-12) + F.col("site_id") * lit(1e-15)
    return e.select("atom_id", "site_id", feasible.alias("feasible"), F.when(feasible, cost).otherwise(lit(FORBIDDEN)).alias("cost"))


def destinations(atoms: DataFrame, assigned: DataFrame, sites: DataFrame, parking: list[tuple[float, float]]) -> DataFrame:
    """atom_id, x, y, site_id, disposition, to_x, to_y: the site's place, else the parking site numbered
    k, else the atom's own place. assigned: atom_id, site_id, disposition, k."""
    goal = sites.select("site_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    spots = F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in parking])
    d = atoms.select("atom_id", "x", "y").join(assigned, "atom_id").join(goal, "site_id", "left")
    spot = F.when(F.col("disposition") == "PARK", F.get(spots, F.col("k")))
    return d.select("atom_id", "x", "y", "site_id", "disposition", F.coalesce("tx", spot["x"], "x").alias("to_x"), F.coalesce("ty", spot["y"], "y").alias("to_y"))
