"""Shortest ways in space and time for many agents on a graph, and plans in which none meet."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.geometry import distance, segment_to_segment
from lumenloom.functions.numeric import lit
from lumenloom.operators.conflicts import boxed, conflicts
from lumenloom.operators.lineage import cut

#: Until which tick a path that has come to rest is in the way.
FOREVER = 1 << 30
#: The ends of a leg and of a move.
ENDS = [f"{m}{c}{e}" for m in ("", "m_") for c in "xy" for e in ("", "_end")]
#: A cell in which agents meet nodes is so many of the longest links wide.
CELL = 8


def _graph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, x, y, nexts, wide, high, far), written: each node once, with the nodes where a tick can lead
    from it, itself among them, and the longest of its links along x, along y and straight."""
    ends = nodes.select("node", "x", "y")
    one = links.select("node", "next").join(ends.toDF("next", "x_end", "y_end"), "next").join(ends, "node")
    spans = [F.abs(F.col("x") - F.col("x_end")).alias("wide"), F.abs(F.col("y") - F.col("y_end")).alias("high"), distance((F.col("x"), F.col("y")), (F.col("x_end"), F.col("y_end"))).alias("far")]
    both = one.select(F.explode(F.array(F.struct("node", "next"), F.struct(F.col("next").alias("node"), F.col("node").alias("next")))).alias("l"), *spans).select("l.*", "wide", "high", "far")
    near = both.groupBy("node").agg(F.collect_set("next").alias("nexts"), *[F.max(c).alias(c) for c in ("wide", "high", "far")])
    mine = F.array("node")
    return cut(ends.join(near, "node", "left").withColumn("nexts", F.coalesce(F.array_union("nexts", mine), mine)))


def _moves(graph: DataFrame) -> DataFrame:
    """All moves and waits of a tick: node, next, x, y, x_end, y_end."""
    ends = graph.select(F.col("node").alias("next"), F.col("x").alias("x_end"), F.col("y").alias("y_end"))
    return graph.select("node", "x", "y", F.explode("nexts").alias("next")).join(ends, "next").select("node", "next", "x", "y", "x_end", "y_end")


def _hops(graph: DataFrame):
    """The least number of ticks between two places, by the longest links; and the largest of these."""
    facts = graph.agg(*[F.max(c).alias(c) for c in ("wide", "high", "far")]).first()
    wide, high, far = (facts[c] or 1.0 for c in ("wide", "high", "far"))

    def hops(x: Column, y: Column, u: Column, v: Column) -> Column:
        ticks = [F.abs(x - u) / lit(wide), F.abs(y - v) / lit(high), distance((x, y), (u, v)) / lit(far)]
        return F.greatest(*[F.ceil(t - lit(1e-9)) for t in ticks]).cast("int")

    return hops, wide, high


def _flat(lists, kind=np.int64) -> np.ndarray:
    return np.concatenate([*lists, np.zeros(0, kind)]).astype(kind)


def _go(f: pd.DataFrame, max_ticks: int) -> pd.DataFrame:
    """The ways of whole agents, all going on together tick by tick; rows of `f` are the nodes in reach of an
    agent, sorted by agent and node. An agent without a way that a larger budget could help has one row
    of tick -1; one that nothing can help has none."""
    node, n = f["node"].to_numpy(), len(f)
    names, a = np.unique(f["agent"].to_numpy(), return_inverse=True)
    known, at = np.unique(node, return_inverse=True)
    key = a * len(known) + at

    def row_of(rows, nodes):
        """Rows of the same agents with other nodes; -1: not in reach."""
        to = np.minimum(np.searchsorted(known, nodes), len(known) - 1)
        place = np.minimum(np.searchsorted(key, want := a[rows] * len(known) + to), n - 1)
        return np.where((known[to] == nodes) & (key[place] == want), place, -1)

    src = np.repeat(np.arange(n), f["nexts"].map(len).to_numpy())
    dst = row_of(src, _flat(f["nexts"]))
    leaves = np.bincount(src[dst < 0], minlength=n) > 0
    src, dst = src[dst >= 0], dst[dst >= 0]
    # Sorted by the place they lead to, then by the one they come from: the first to reach a place counts.
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    clear, w_edge = np.zeros(len(names), np.int64), np.zeros(0, np.int64)
    if "w_next" in f:
        closed = f["w_next"].notna().to_numpy()
        w_row = np.repeat(np.flatnonzero(closed), f["w_next"][closed].map(len).to_numpy())
        w_next, w_from, w_until = (_flat(f[c][closed]) for c in ("w_next", "w_from", "w_until"))
        to = row_of(w_row, w_next)
        ends = (to == w_row) & (node[w_row] == f["goal"].to_numpy()[w_row])
        np.maximum.at(clear, a[w_row[ends]], w_until[ends] + 1)
        w_row, to, w_from, w_until = w_row[to >= 0], to[to >= 0], w_from[to >= 0], w_until[to >= 0]
        edge = dst * n + src
        w_edge = np.minimum(np.searchsorted(edge, to * n + w_row), max(len(edge) - 1, 0))
        real = edge[w_edge] == to * n + w_row
        w_edge, w_from, w_until = w_edge[real], w_from[real], w_until[real]
    budget, left = f["budget"].to_numpy(), f["left"].to_numpy()
    goal, front = node == f["goal"].to_numpy(), node == f["start"].to_numpy()
    arrived, rest, short, before, tick = np.full(len(names), -1), np.zeros(len(names), np.int64), clear > 0, [], 0
    while True:
        there = np.flatnonzero(front & goal & (clear[a] <= tick))
        arrived[a[there]], rest[a[there]] = tick, there
        front &= arrived[a] < 0
        if not front.any():
            break
        on = front[src]
        if len(w_edge):
            on[w_edge[(w_from <= tick) & (w_until >= tick)]] = False
        late = on & (left[dst] + tick + 1 > budget[dst])
        short[a[src[late]]] = True
        short[a[front & leaves]] = True
        e = np.flatnonzero(on & ~late)
        e = e[np.concatenate(([True], dst[e][1:] != dst[e][:-1]))[: len(e)]]
        came = np.full(n, -1)
        came[dst[e]] = src[e]
        before.append(came)
        front, tick = came >= 0, tick + 1
    again = (arrived < 0) & short & (clear <= max_ticks) & (budget[np.searchsorted(a, np.arange(len(names)))] < max_ticks)
    out = [(names[again], np.full(again.sum(), -1), np.full(again.sum(), -1), np.zeros(again.sum()), np.zeros(again.sum()))]
    x, y = f["x"].to_numpy(), f["y"].to_numpy()
    for t in range(int(arrived.max(initial=-1)), -1, -1):
        who = np.flatnonzero(arrived >= t)
        out.append((names[who], np.full(len(who), t), node[rest[who]], x[rest[who]], y[rest[who]]))
        if t:
            rest[who] = before[t - 1][rest[who]]
    return pd.DataFrame(dict(zip(("agent", "tick", "node", "x", "y"), map(np.concatenate, zip(*out)))))


def _searched(agents: DataFrame, graph: DataFrame, hops, wide: float, high: float, forbidden: DataFrame | None, max_ticks: int) -> DataFrame:
    """(agent, tick, node, x, y) as of `_go`, written. agents: agent, start, goal, sx, sy, gx, gy, budget.

    Agents meet the nodes from which start and goal can both be near enough on grid cells; these nodes, with
    what is forbidden there, come together for each agent once, instead of its states at every tick.
    """
    over = lambda s, g, step: (F.col("budget") * lit(step) - F.abs(F.col(s) - F.col(g))) / 2 + lit(1e-6)
    low = lambda s, g, step: F.floor((F.least(s, g) - over(s, g, step)) / lit(CELL * step)).cast("long")
    top = lambda s, g, step: F.floor((F.greatest(s, g) + over(s, g, step)) / lit(CELL * step)).cast("long")
    cells = agents.select("*", F.explode(F.sequence(low("sx", "gx", wide), top("sx", "gx", wide))).alias("cx"), F.sequence(low("sy", "gy", high), top("sy", "gy", high)).alias("_ys")).select("*", F.explode("_ys").alias("cy")).drop("_ys")
    places = graph.select("node", "x", "y", "nexts", F.floor(F.col("x") / lit(CELL * wide)).cast("long").alias("cx"), F.floor(F.col("y") / lit(CELL * high)).cast("long").alias("cy"))
    x, y, left = F.col("x"), F.col("y"), hops(F.col("x"), F.col("y"), F.col("gx"), F.col("gy"))
    inside = hops(F.col("sx"), F.col("sy"), x, y) + left <= F.col("budget")
    near = cells.join(places, ["cx", "cy"]).where(inside).select("agent", "start", "goal", "budget", "node", "x", "y", "nexts", left.alias("left"))
    if forbidden is not None:
        near = cut(near)
        of = forbidden.join(near.select("node").distinct(), "node", "left_semi").groupBy("node").agg(*[F.collect_list(F.col(c).cast("long")).alias(f"w_{c}") for c in ("next", "from", "until")])
        near = near.join(of, "node", "left")

    def whole(frames):
        held = None
        for frame in frames:
            held = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
            done = held["agent"] != held["agent"].iloc[-1] if len(held) else pd.Series([], dtype=bool)
            if done.any():
                yield _go(held[done].reset_index(drop=True), max_ticks)
                held = held[~done].reset_index(drop=True)
        if held is not None and len(held):
            yield _go(held, max_ticks)

    return cut(near.repartition("agent").sortWithinPartitions("agent", "node").mapInPandas(whole, "agent long, tick int, node long, x double, y double"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _shortest(agents: DataFrame, graph: DataFrame, measure, forbidden: DataFrame | None, max_ticks: int, slack: int) -> DataFrame:
    """As `shortest`, with x and y of the nodes."""
    hops, wide, high = measure
    at = graph.select("node", "x", "y")
    placed = agents.select("agent", "start", "goal").join(at.toDF("start", "sx", "sy"), "start").join(at.toDF("goal", "gx", "gy"), "goal")
    placed = cut(placed.withColumn("hops", hops(F.col("sx"), F.col("sy"), F.col("gx"), F.col("gy"))).where(F.col("hops") <= max_ticks))
    left, found, more = placed, [], 0
    while True:
        ways = _searched(left.withColumn("budget", F.least(F.col("hops") + more, F.lit(max_ticks))), graph, hops, wide, high, forbidden, max_ticks)
        found.append(ways.where("tick >= 0"))
        again = ways.where("tick < 0").select("agent")
        if more >= max_ticks or not again.limit(1).count():
            return _all(found)
        left, more = placed.join(again, "agent", "left_semi"), more * 2 or max(slack, 1)


def shortest(agents: DataFrame, nodes: DataFrame, links: DataFrame, forbidden: DataFrame | None = None, *, max_ticks: int = 64, slack: int = 4) -> DataFrame:
    """(agent, tick, node): a way of least arrival for every agent that has one within max_ticks.

    agents: agent, start, goal. nodes: node, x, y; links: node, next, in both directions; every tick an
    agent goes along a link or waits. forbidden: node, next, from, until: moves (or waits, node = next)
    that can't begin at those ticks; an agent comes to rest only where it may wait for good. Of equal
    ways the state before is the smallest node.

    A state is kept while its arrival, by the distance to the goal over the longest links, can be within
    the agent's budget: first the least number of ticks between its ends, which is all that most ways take,
    then `slack` more, then twice the slack. No budget changes a way that is found within it, so a way of
    the least budget is that of any other.
    """
    graph = _graph(nodes, links)
    return _shortest(agents, graph, _hops(graph), forbidden, max_ticks, slack).select("agent", "tick", "node")


def _gap(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Distances of segments a b and c d, given as (x, y), as geometry.segment_to_segment: over so many pairs
    the column expression takes most of the time of a plan."""

    def to(p, q, r):
        along, size = ((p - q) * (r - q)).sum(0), ((r - q) ** 2).sum(0)
        t = np.where(size > 0, np.clip(along / np.where(size > 0, size, 1), 0, 1), 0)
        return np.hypot(*(p - q - (r - q) * t))

    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    cross = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    return np.where(cross, 0, np.minimum.reduce([to(a, c, d), to(b, c, d), to(c, a, b), to(d, a, b)]))


def _reserved(ways: DataFrame, moves: DataFrame, safe: float) -> DataFrame:
    """As `reservations`, of ways with x and y and boxed moves (m_x and so on)."""
    now = ways.select("agent", "tick", "x", "y")
    then = now.select("agent", (F.col("tick") - 1).alias("tick"), F.col("x").alias("x_end"), F.col("y").alias("y_end"))
    legs = now.join(then, ["agent", "tick"], "left")
    resting = F.col("x_end").isNull()
    legs = legs.select("x", "y", F.coalesce("x_end", "x").alias("x_end"), F.coalesce("y_end", "y").alias("y_end"), F.col("tick").alias("from"), F.when(resting, F.lit(FOREVER)).otherwise(F.col("tick")).alias("until"))
    # Written, so that the plan knows when they are few.
    a = cut(boxed(legs, safe / 2, 4 * safe))
    lowest = (F.col("cx") == F.greatest("lx", "m_lx")) & (F.col("cy") == F.greatest("ly", "m_ly"))
    apart = lambda c: F.greatest(F.least(c, f"{c}_end"), F.least(f"m_{c}", f"m_{c}_end")) - F.least(F.greatest(c, f"{c}_end"), F.greatest(f"m_{c}", f"m_{c}_end"))
    pairs = a.join(moves, ["cx", "cy"]).where(lowest).where((apart("x") < lit(safe)) & (apart("y") < lit(safe)))

    def near(frames):
        for f in frames:
            at = [f[[c, c.replace("x", "y")]].to_numpy(float).T for c in ("x", "x_end", "m_x", "m_x_end")]
            yield f.loc[_gap(*at) < safe - 1e-9, ["node", "next", "from", "until"]]

    met = pairs.select("node", "next", "from", "until", *ENDS).mapInPandas(near, "node long, next long, from int, until int")
    return met.select(F.explode(F.array(F.struct("node", "next"), F.struct(F.col("next").alias("node"), F.col("node").alias("next")))).alias("l"), "from", "until").select("l.*", "from", "until").distinct()


def _boxed_moves(graph: DataFrame, safe: float) -> DataFrame:
    """The moves in their cells, those there and back once, dealt out by cells."""
    wide = boxed(_moves(graph).where("node <= next"), safe / 2, 4 * safe).withColumnsRenamed({c: f"m_{c}" for c in ("x", "y", "x_end", "y_end", "lx", "ly")})
    return wide.repartition(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cx", "cy")


def reservations(ways: DataFrame, nodes: DataFrame, links: DataFrame, safe: float) -> DataFrame:
    """(node, next, from, until): the moves that would come nearer than safe to the given ways (agent, tick,
    node); a way's last place is taken for good. Moves and ways meet on grid cells."""
    return _reserved(ways.join(nodes.select("node", "x", "y"), "node"), _boxed_moves(_graph(nodes, links), safe), safe)


def _met(placed: DataFrame, safe: float) -> DataFrame:
    return conflicts(placed.select(F.col("agent").alias("trajectory"), "tick", "x", "y", lit(0).alias("sigma")), minimum=safe, margin=0.0, sigmas=0.0)


def grid_conflicts(ways: DataFrame, nodes: DataFrame, safe: float) -> DataFrame:
    """(a_id, b_id, tick, kind) of the first conflicts of ways on a graph (agent, tick, node)."""
    return _met(cut(ways.join(nodes.select("node", "x", "y"), "node")), safe)


def planned(agents: DataFrame, nodes: DataFrame, links: DataFrame, *, safe: float, forbidden: DataFrame | None = None, max_ticks: int = 64, slack: int = 4) -> DataFrame:
    """(agent, tick, node): ways of which no two come nearer than safe; agents without one are missing.

    In a round all agents that are left look for ways that keep clear of all reserved ones. Those that
    conflict with no agent of a smaller number are reserved, the others try again: agents plan in order
    of their numbers where they meet, and at a time where they don't. The smallest agent left is reserved
    in every round, so rounds end by themselves. An agent that finds no way among the reserved ones is left
    out; it stays where it is, so callers check its start (`grid_conflicts`).
    """
    graph = _graph(nodes, links)
    measure, moves = _hops(graph), cut(_boxed_moves(graph, safe))
    left, taken, done = cut(agents.select("agent", "start", "goal")), forbidden, []
    while True:
        ways = _shortest(left, graph, measure, taken, max_ticks, slack)
        behind = cut(_met(ways, safe).select(F.col("b_id").alias("agent")).distinct())
        fixed = cut(ways.join(behind, "agent", "left_anti"))
        done.append(fixed.select("agent", "tick", "node"))
        if not behind.limit(1).count():
            return _all(done)
        left = cut(left.join(behind, "agent", "left_semi"))
        more = _reserved(fixed, moves, safe)
        taken = cut(more) if taken is None else taken.unionByName(cut(more))
