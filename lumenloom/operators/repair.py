"""Assignment and planning in turns: what can't be planned is made dearer and assigned again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit
from lumenloom.operators import auction, conflicts
from lumenloom.operators.lineage import cut

Plan = Callable[[DataFrame], DataFrame]


def direct_ways(atoms: DataFrame, sites: DataFrame, *, minimum: float, margin: float, sigmas: float) -> Plan:
    """A plan in which all atoms go straight to their sites in one tick, the others staying where they are;
    gives the conflicts of these ways."""
    goals = sites.select("site_id", F.col("x").alias("tx"), F.col("y").alias("ty"))

    def plan(assigned: DataFrame) -> DataFrame:
        both = atoms.select(F.col("atom_id").alias("trajectory"), "x", "y", "sigma").join(assigned.select(F.col("atom_id").alias("trajectory"), "site_id"), "trajectory", "left").join(goals, "site_id", "left")
        stops = F.when(F.col("tx").isNull(), F.array(F.struct(F.lit(0).alias("tick"), "x", "y"))).otherwise(F.array(F.struct(F.lit(0).alias("tick"), "x", "y"), F.struct(F.lit(1).alias("tick"), F.col("tx").alias("x"), F.col("ty").alias("y"))))
        ways = cut(both.select("trajectory", "sigma", F.inline(stops)))
        return conflicts.conflicts(ways, minimum=minimum, margin=margin, sigmas=sigmas)

    return plan


def repaired(edges: DataFrame, plan: Plan, *, retries: int, penalty: float, resolution: float = 1e-6) -> DataFrame:
    """(atom_id, site_id, cost, attempt, conflicts): the first assignment of all sites that can be planned, its
    costs with the penalties paid; if none is within 1 + retries attempts, the last, with the number of
    its conflicts.

    edges: atom_id, site_id, cost, allowed ones only. plan gives the conflicts of an assignment, none if
    it can be carried out. After a failure every edge that was used costs `penalty` more, again and again
    as it is used again, and the whole assignment is solved anew. Penalties and assignment are a table
    for each attempt; the driver holds their number alone. Raises auction.Infeasible if sites can't all be
    served; no sites give no rows.
    """
    paid = None
    for attempt in range(1, retries + 2):
        now = edges.select("atom_id", "site_id", "cost")
        if paid is not None:
            now = cut(now.join(paid, ["atom_id", "site_id"], "left").select("atom_id", "site_id", (F.col("cost") + F.coalesce("penalty", lit(0))).alias("cost")))
        bids = now.select(F.col("site_id").alias("person"), F.col("atom_id").alias("object"), "cost")
        taken = auction.cover(bids, resolution=resolution).select(F.col("object").alias("atom_id"), F.col("person").alias("site_id"))
        assigned = cut(now.join(taken, ["atom_id", "site_id"]))
        open_ = plan(assigned).count()
        if not open_ or attempt > retries:
            return assigned.withColumns({"attempt": F.lit(attempt), "conflicts": F.lit(open_).cast("long")})
        used = assigned.select("atom_id", "site_id", lit(penalty).alias("penalty"))
        paid = cut(used if paid is None else paid.unionByName(used).groupBy("atom_id", "site_id").agg(F.sum("penalty").alias("penalty")))
    raise ValueError("retries can't be negative")
