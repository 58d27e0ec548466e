"""Greedy selections of points that keep apart, decided in rounds over neighbours instead of one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.numeric import half_up, lit
from lumenloom.operators.lineage import cut
from lumenloom.operators.order import numbered


def _too_near(earlier: DataFrame, later: DataFrame, dx: float, dy: float, inclusive: bool) -> DataFrame:
    """Pairs (e, l) of places with less than one unit of (dx, dy) between them (or one, if inclusive), e
    before l. Earlier places stand in their own cell, later ones in the cells within a unit of them: mostly
    one or two, as cells are four units wide."""
    cell = lambda c, d, more=0.0: F.floor(F.col(c) / lit(4 * d) + lit(more)).cast("long")
    spread = lambda c, d: F.sequence(cell(c, d, -0.25 * (1 + 1e-9)), cell(c, d, 0.25 * (1 + 1e-9)))
    a = earlier.select(F.col("place").alias("e"), F.col("x").alias("ex"), F.col("y").alias("ey"), cell("x", dx).alias("cx"), cell("y", dy).alias("cy"))
    b = later.select(F.col("place").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.explode(spread("x", dx)).alias("cx"), spread("y", dy).alias("_ys")).select("l", "lx", "ly", "cx", F.explode("_ys").alias("cy"))
    gap = F.hypot((F.col("ex") - F.col("lx")) / lit(dx), (F.col("ey") - F.col("ly")) / lit(dy))
    return a.join(b, ["cx", "cy"]).where(F.col("e") < F.col("l")).where(gap <= 1 if inclusive else gap < 1).select("e", "l")


def dropped(pairs: DataFrame) -> DataFrame:
    """(place): those that a greedy pass leaves out, from the pairs (e, l) that can't both stay, e first.

    In a round every place without an open earlier neighbour stays and its later neighbours go; with
    both their pairs go. What is left without pairs stays. The result is that of the pass in order; the
    number of rounds is the longest chain of decisions that hang on each other, in random order about
    the logarithm of their number.
    """
    open_ = cut(pairs)
    out = None
    while open_.limit(1).count():
        waiting = open_.select(F.col("l").alias("e")).distinct()
        gone = cut(open_.join(waiting, "e", "left_anti").select(F.col("l").alias("place")).distinct())
        out = gone if out is None else out.unionByName(gone)
        open_ = cut(open_.join(gone.withColumnRenamed("place", "l"), "l", "left_anti").join(gone.withColumnRenamed("place", "e"), "e", "left_anti"))
    return out if out is not None else pairs.select(F.col("e").alias("place")).where("false")


def apart(points: DataFrame, order: list[Column | str], dx: float, dy: float, *, inclusive: bool = False, digits: int | None = None, existing: DataFrame | None = None, at_most: int | None = None) -> DataFrame:
    """The points that, taken in a total order, keep a unit of (dx, dy) from all taken before them: columns
    of points (x, y among them) and `place` in the order.

    inclusive: a unit exactly is too near as well. digits: a taken point is rounded to so many digits,
    and later ones keep away from the rounded place. existing: points (x, y) taken beforehand, whatever
    stands between them. at_most: only so many points, the existing ones included; the first stay.
    Any null coordinate drops a point; ties of the order must be broken by its last column.
    """
    near = lambda df: df if digits is None else df.withColumn("x", half_up(F.col("x"), digits)).withColumn("y", half_up(F.col("y"), digits))
    placed = cut(numbered(points.where("x is not null and y is not null"), order, "place"))
    if existing is not None:
        taken = near(existing.select("x", "y")).withColumn("place", F.lit(-1).cast("long"))
        beside = _too_near(taken, placed, dx, dy, inclusive).select(F.col("l").alias("place")).distinct()
        placed = cut(placed.join(beside, "place", "left_anti"))
    kept = placed.join(dropped(_too_near(near(placed), placed, dx, dy, inclusive)), "place", "left_anti")
    if at_most is not None:
        left = max(0, at_most - (existing.limit(at_most).count() if existing is not None else 0))
        kept = kept.orderBy("place").limit(left)
    return near(kept).select(*points.columns, "place")
