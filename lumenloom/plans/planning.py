"""Ways of all atoms over a lattice, in space and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit
from lumenloom.operators import spacetime
from lumenloom.operators.lineage import cut
from lumenloom.plans import views
from lumenloom.plans.catalog import query

#: A node is numbered by its place on the lattice, 2 apart; rows of so many nodes.
ROW = 1_000


def _scene(spark, sf_dir):
    """agents (agent, start, goal), nodes and links of the lattice without the nodes of fixed traps.

    Homes are 3 nodes apart; some have a fixed trap beside them. The goal of a path is the node of its
    last waypoint, if no trap and no home is there and no smaller path has it; otherwise it stays.
    """
    way = views.ways(spark, sf_dir)
    key = F.col("trajectory")
    last = way.groupBy(key).agg(F.max_by(F.struct("x", "y"), "seq").alias("l"))
    h = cut(last.select("trajectory", (3 * (key % 32)).alias("hx"), (3 * F.floor(key / 32)).alias("hy"), F.floor(F.col("l.x") / lit(2)).alias("wx"), F.floor(F.col("l.y") / lit(2)).alias("wy")))
    number = lambda x, y: (F.col(y) + 10) * ROW + F.col(x) + 10
    traps = h.where(key % 4 == 1).select(((F.col("hy") + 11) * ROW + F.col("hx") + 11).alias("node"))
    first = h.groupBy("wx", "wy").agg(F.min("trajectory").alias("first"))
    free = h.join(first, ["wx", "wy"]).withColumn("goal", number("wx", "wy")).join(traps.select(F.col("node").alias("goal"), F.lit(True).alias("trap")), "goal", "left")
    ok = (F.col("first") == key) & F.col("trap").isNull() & ~((F.col("wx") % 3 == 0) & (F.col("wy") % 3 == 0))
    agents = cut(free.select(key.alias("agent"), number("hx", "hy").alias("start"), F.when(ok, F.col("goal")).otherwise(number("hx", "hy")).alias("goal")))
    # The lattice reaches 6 nodes beyond each home.
    steps = F.sequence(F.lit(-6), F.lit(6))
    around = h.select("hx", "hy", F.explode(steps).alias("i")).select("hx", "hy", "i", F.explode(steps).alias("j")).select((F.col("hx") + F.col("i")).alias("gx"), (F.col("hy") + F.col("j")).alias("gy")).distinct()
    nodes = cut(around.withColumn("node", number("gx", "gy")).join(traps, "node", "left_anti").select("node", (lit(2) * F.col("gx")).alias("x"), (lit(2) * F.col("gy")).alias("y")))
    near = nodes.select("node", F.explode(F.array(*[F.lit(v) for v in (1, ROW - 1, ROW, ROW + 1)])).alias("by")).select("node", (F.col("node") + F.col("by")).alias("next"))
    return agents, nodes, near.join(nodes.select(F.col("node").alias("next")), "next", "left_semi")


@query()
def gen_07_shortest_ways(spark, sf_dir):
    """Ticks of the shortest way of every atom around fixed traps, each for itself."""
    found = spacetime.shortest(*_scene(spark, sf_dir))
    return found.groupBy("agent").agg(F.max("tick").cast("int").alias("ticks"))


@query()
def gen_08_nodes_of_ways(spark, sf_dir):
    """The nodes of the shortest ways, tick by tick."""
    return spacetime.shortest(*_scene(spark, sf_dir))


@query()
def gen_09_clear_ways(spark, sf_dir):
    """Ways of all atoms that keep clear of each other, tick by tick."""
    return spacetime.planned(*_scene(spark, sf_dir), safe=1.0)


@query()
def join_13_grid_conflicts(spark, sf_dir):
    """First conflicts of the shortest ways with each other."""
    agents, nodes, links = _scene(spark, sf_dir)
    return spacetime.grid_conflicts(spacetime.shortest(agents, nodes, links), nodes, safe=1.0)
