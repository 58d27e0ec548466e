"""Plane geometry as column expressions; a point is a pair of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.numeric import clamp, lit

Point = tuple[Column, Column]


def distance_squared(a: Point, b: Point) -> Column:
    return (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(distance_squared(a, b))


def orientation(a: Point, b: Point, c: Point) -> Column:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def point_to_segment(p: Point, a: Point, b: Point) -> Column:
    """Distance to the nearest point of a segment; a segment of no length is its end."""
    size = distance_squared(a, b)
    along = (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])
    t = F.when(size > 0, clamp(F.try_divide(along, size), lit(0), lit(1))).otherwise(lit(0))
    return distance(p, (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))


def segments_cross(a: Point, b: Point, c: Point, d: Point, eps: float = 1e-10) -> Column:
    """Whether two segments share a point: proper crossings, and ends that lie on the other."""

    def on(p: Point, q: Point, r: Point) -> Column:
        flat = F.abs(orientation(p, q, r)) <= lit(eps)
        return flat & r[0].between(F.least(p[0], q[0]) - lit(eps), F.greatest(p[0], q[0]) + lit(eps)) & r[1].between(F.least(p[1], q[1]) - lit(eps), F.greatest(p[1], q[1]) + lit(eps))

    proper = (orientation(a, b, c) * orientation(a, b, d) < 0) & (orientation(c, d, a) * orientation(c, d, b) < 0)
    return proper | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def segment_to_segment(a: Point, b: Point, c: Point, d: Point) -> Column:
    apart = F.least(point_to_segment(a, c, d), point_to_segment(b, c, d), point_to_segment(c, a, b), point_to_segment(d, a, b))
    return F.when(segments_cross(a, b, c, d), lit(0)).otherwise(apart)


def in_circle(p: Point, centre: Point, radius: Column, clearance: Column) -> Column:
    return distance(p, centre) <= radius + clearance


def in_box(p: Point, low: Point, high: Point, clearance: Column) -> Column:
    dx = F.greatest(low[0] - p[0], p[0] - high[0], lit(0))
    dy = F.greatest(low[1] - p[1], p[1] - high[1], lit(0))
    return F.sqrt(dx * dx + dy * dy) <= clearance


def in_polygon(p: Point, xs: Column, ys: Column) -> Column:
    """Even-odd rule over parallel arrays of corners; points on an edge are inside."""
    n = F.size(xs)

    def edge(i: Column) -> tuple[Point, Point]:
        j = F.pmod(i + 1, n)
        return (F.get(xs, i), F.get(ys, i)), (F.get(xs, j), F.get(ys, j))

    def crossed(i: Column) -> Column:
        a, b = edge(i)
        at = a[0] + (b[0] - a[0]) * F.coalesce(F.try_divide(p[1] - a[1], b[1] - a[1]), lit(0))
        return ((a[1] > p[1]) != (b[1] > p[1])) & (p[0] < at)

    def touched(i: Column) -> Column:
        return point_to_segment(p, *edge(i)) <= lit(1e-10)

    every = F.sequence(F.lit(0), n - 1)
    return F.exists(every, touched) | (F.size(F.filter(every, crossed)) % 2 == 1)


def inside_corners(p: Point, corners: list[Point]) -> Column:
    """in_polygon for a fixed list of corners."""
    edges = list(zip(corners, (*corners[1:], corners[0])))
    crossed = sum((F.when(((a[1] > p[1]) != (b[1] > p[1])) & (p[0] < a[0] + (b[0] - a[0]) * F.coalesce(F.try_divide(p[1] - a[1], b[1] - a[1]), lit(0))), 1).otherwise(0) for a, b in edges), F.lit(0))
    return (crossed % 2 == 1) | (_least([point_to_segment(p, a, b) for a, b in edges]) <= lit(1e-10))


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def to_polygon(p: Point, corners: list[Point]) -> Column:
    """Distance to a polygon of fixed corners, 0 inside."""
    edges = zip(corners, (*corners[1:], corners[0]))
    return F.when(inside_corners(p, corners), lit(0)).otherwise(_least([point_to_segment(p, a, b) for a, b in edges]))


def segment_in_polygon(a: Point, b: Point, corners: list[Point], clearance: Column) -> Column:
    """Whether a segment comes within the clearance of a polygon: an end lies inside, or an edge is near."""
    edges = zip(corners, (*corners[1:], corners[0]))
    return inside_corners(a, corners) | inside_corners(b, corners) | (_least([segment_to_segment(a, b, c, d) for c, d in edges]) <= clearance)


def circle_corners(centre: Point, radius: Column, n: int = 32) -> Column:
    angle = lambda i: lit(2 * math.pi * i / n)
    return F.array(*[F.struct((centre[0] + F.cos(angle(i)) * radius).alias("x"), (centre[1] + F.sin(angle(i)) * radius).alias("y")) for i in range(n)])


def box_corners(low: Point, high: Point) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((low[0], low[1]), (high[0], low[1]), (high[0], high[1]), (low[0], high[1]))])
