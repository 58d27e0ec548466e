"""Conflicts between simultaneous paths of one plane, found on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions.geometry import distance, segment_to_segment
from lumenloom.functions.numeric import lit


def boxed(df: DataFrame, around: float | Column, cell: float) -> DataFrame:
    """df in every cell that its segment's bounding box, widened by `around`, has a part of; lx, ly: the
    lowest of them."""
    around = around if isinstance(around, Column) else lit(around)
    low = {c: F.floor((F.least(c, f"{c}_end") - around) / lit(cell)).cast("long") for c in "xy"}
    high = {c: F.floor((F.greatest(c, f"{c}_end") + around) / lit(cell)).cast("long") for c in "xy"}
    wide = df.select("*", low["x"].alias("lx"), low["y"].alias("ly"), F.explode(F.sequence(low["x"], high["x"])).alias("cx"), F.sequence(low["y"], high["y"]).alias("_ys"))
    return wide.select("*", F.explode("_ys").alias("cy")).drop("_ys")


def conflicts(ways: DataFrame, *, minimum: float, margin: float, sigmas: float, cell: float | None = None) -> DataFrame:
    """(a_id, b_id, tick, kind): the first tick at which two paths of the plane come nearer than minimum +
    margin + sigmas * (both sigma), and how: vertex (where they stand), edge (they change places),
    near-edge (between).

    ways: trajectory, tick, x, y, sigma; a path has a place for each tick from 0 to its last and then
    stays there, in the way of others, until the last tick of all. Moving parts meet moving parts by
    tick and cell, and those that have come to rest by cell. A part stands in the cells of its bounding
    box, widened by half of the largest separation, and a pair is taken in the lowest cell that both
    have, so no pair is formed beyond neighbouring cells and each but once. Sides grow with the table
    alike, so they are merged and none passes through the driver.
    """
    order = W.partitionBy("trajectory").orderBy("tick")
    legs = ways.select("trajectory", "tick", "x", "y", "sigma", *[F.lead(c).over(order).alias(f"{c}_end") for c in ("x", "y")])
    facts = ways.agg(F.max("sigma").alias("sigma"), F.greatest(F.lit(1), F.max("tick")).alias("top")).first()
    widest = minimum + margin + 2 * sigmas * float(facts["sigma"] or 0.0)
    size = max(cell or 4 * widest, 1e-9)
    moving = boxed(legs.where("x_end is not null"), widest / 2, size)
    rest = boxed(legs.where("x_end is null").withColumn("x_end", F.col("x")).withColumn("y_end", F.col("y")), widest / 2, size)
    named = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in ("trajectory", "tick", "x", "y", "x_end", "y_end", "sigma", "lx", "ly")], "cx", "cy", F.col("tick").alias(f"{s}_at"))
    p, q = named(moving, "p"), named(moving, "q")
    p_rest, q_rest = named(rest, "p"), named(rest, "q").hint("merge")
    ahead = F.col("p_trajectory") < F.col("q_trajectory")
    pairs = [
        p.withColumnRenamed("p_at", "tick").join(q.withColumnRenamed("q_at", "tick").hint("merge"), ["tick", "cx", "cy"]).where(ahead),
        p.join(q_rest, ["cx", "cy"]).where((F.col("q_tick") <= F.col("p_tick")) & (F.col("p_trajectory") != F.col("q_trajectory"))).withColumn("tick", F.col("p_tick")),
        p_rest.join(q_rest, ["cx", "cy"]).where(ahead).withColumn("tick", F.greatest("p_tick", "q_tick")).where(F.col("tick") < F.lit(facts["top"] or 1)),
    ]
    lowest = (F.col("cx") == F.greatest("p_lx", "q_lx")) & (F.col("cy") == F.greatest("p_ly", "q_ly"))
    at = lambda s, e="": (F.col(f"{s}_x{e}"), F.col(f"{s}_y{e}"))
    # Boxes farther apart than any separation are told by four comparisons, before distances are measured.
    apart = lambda c: F.greatest(*[F.least(f"{s}_{c}", f"{s}_{c}_end") for s in "pq"]) - F.least(*[F.greatest(f"{s}_{c}", f"{s}_{c}_end") for s in "pq"])
    near = (apart("x") < lit(widest + 1e-9)) & (apart("y") < lit(widest + 1e-9))
    limit = lit(minimum + margin) + lit(sigmas) * (F.col("p_sigma") + F.col("q_sigma")) - lit(1e-9)
    swapped = (distance(at("p"), at("q", "_end")) < limit) & (distance(at("p", "_end"), at("q")) < limit)
    between = segment_to_segment(at("p"), at("p", "_end"), at("q"), at("q", "_end")) < limit
    kind = F.when(distance(at("p"), at("q")) < limit, "vertex").when(swapped, "edge").when(between, "near-edge")
    met = None
    for found in pairs:
        one = found.where(lowest).where(near).select(F.least("p_trajectory", "q_trajectory").alias("a_id"), F.greatest("p_trajectory", "q_trajectory").alias("b_id"), "tick", kind.alias("kind")).where("kind is not null")
        met = one if met is None else met.unionByName(one)
    return met.groupBy("a_id", "b_id").agg(F.min(F.struct("tick", "kind")).alias("m")).select("a_id", "b_id", "m.tick", "m.kind")
