"""Ways in space and time against a plain search."""

import numpy as np
import pytest

from lumenloom.operators import spacetime
from lumenloom.operators.lineage import cut
from lumenloom.plans import planning, registry


def search(start, goal, near, forbidden, max_ticks):
    """Least arrival at which the agent may come to rest; forbidden: {(node, next): [(from, until)]}."""
    free = lambda a, b, t: all(not lo <= t <= hi for lo, hi in forbidden.get((a, b), []))
    clear = max((hi + 1 for _, hi in forbidden.get((goal, goal), [])), default=0)
    front, tick = {start}, 0
    while front and tick <= max_ticks:
        if goal in front and tick >= clear:
            return tick
        front = {b for a in front for b in (a, *near.get(a, ())) if free(a, b, tick)}
        tick += 1
    return None


def both_ways(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def lattice(width, height, without=()):
    at = {y * 100 + x: (float(2 * x), float(2 * y)) for x in range(width) for y in range(height) if (x, y) not in without}
    links = [(a, a + by) for a in at for by in (1, 99, 100, 101) if a + by in at]
    return at, links


def tables(spark, at, links):
    return spark.createDataFrame([(k, *p) for k, p in at.items()], "node long, x double, y double"), spark.createDataFrame(links, "node long, next long")


def ways_of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r.tick):
        out.setdefault(r.agent, []).append((r.tick, r.node))
    assert all([t for t, _ in w] == list(range(len(w))) for w in out.values())
    return {a: [n for _, n in w] for a, w in out.items()}


def test_shortest_ways_among_reservations(spark):
    rng = np.random.default_rng(6)
    at, links = lattice(6, 5, {(2, 1), (2, 2), (2, 3), (2, 4)})
    near, places = both_ways(links), sorted(at)
    agents = [(k, int(a), int(b)) for k, (a, b) in enumerate(rng.choice(places, (12, 2)))]
    moves = [(a, b) for a in near for b in (a, *near[a])]
    taken = [(*moves[int(k)], int(t), int(t + d)) for k, t, d in zip(rng.integers(0, len(moves), 120), rng.integers(0, 8, 120), rng.integers(0, 6, 120))]
    forbidden = {}
    for a, b, lo, hi in taken:
        forbidden.setdefault((a, b), []).append((lo, hi))
    found = ways_of(spacetime.shortest(spark.createDataFrame(agents, "agent long, start long, goal long"), *tables(spark, at, links), spark.createDataFrame(taken, "node long, next long, from int, until int"), max_ticks=30))
    for k, start, goal in agents:
        best = search(start, goal, near, forbidden, 30)
        assert (len(found[k]) - 1 if k in found else None) == best
        if k in found:
            assert found[k][0] == start and found[k][-1] == goal
            for t, (a, b) in enumerate(zip(found[k], found[k][1:])):
                assert (a == b or b in near[a]) and all(not lo <= t <= hi for lo, hi in forbidden.get((a, b), []))


def test_no_way_is_no_row(spark):
    nodes, links = tables(spark, {0: (0.0, 0.0), 1: (2.0, 0.0), 9: (50.0, 0.0)}, [(0, 1)])
    agents = spark.createDataFrame([(1, 0, 9), (2, 0, 1), (3, 9, 9)], "agent long, start long, goal long")
    assert ways_of(spacetime.shortest(agents, nodes, links, max_ticks=8)) == {2: [0, 1], 3: [9]}


@pytest.mark.parametrize("without", [(), {(0, 0), (0, 2), (1, 0), (1, 2), (3, 0), (3, 2), (4, 0), (4, 2)}])
def test_agents_that_change_places(spark, without):
    """On an open lattice, and in a corridor with one bay."""
    at, links = lattice(5, 3, without)
    nodes, edges = tables(spark, at, links)
    agents = spark.createDataFrame([(1, 100, 104), (2, 104, 100)], "agent long, start long, goal long")
    alone = spacetime.shortest(agents, nodes, edges)
    found = spacetime.planned(agents, nodes, edges, safe=1.0, max_ticks=20)
    ways = ways_of(found)
    assert spacetime.grid_conflicts(alone, nodes, 1.0).count() == 1
    assert {a: (w[0], w[-1]) for a, w in ways.items()} == {1: (100, 104), 2: (104, 100)}
    assert spacetime.grid_conflicts(found, nodes, 1.0).count() == 0


def test_ways_over_whole_tables(spark, sf_dir):
    agents, nodes, links = planning._scene(spark, sf_dir)
    near = both_ways([(r.node, r.next) for r in links.collect()])
    given = {r.agent: (r.start, r.goal) for r in agents.collect()}
    assert len({g for _, g in given.values()}) == len(given)
    alone = ways_of(spacetime.shortest(agents, nodes, links))
    assert {a: len(w) - 1 for a, w in alone.items()} == {a: search(*p, near, {}, 64) for a, p in given.items()}
    found = cut(registry.QUERIES["gen_09_clear_ways"](spark, sf_dir))
    ways = ways_of(found)
    assert spacetime.grid_conflicts(found, nodes, 1.0).count() == 0
    assert all((w[0], w[-1]) == given[a] and len(w) >= len(alone[a]) for a, w in ways.items())
    assert len(ways) == len(given) and any(len(w) > len(alone[a]) or w != alone[a] for a, w in ways.items())


def test_repair_makes_used_edges_dearer_until_a_plan_is_clear(spark):
    from itertools import permutations

    from lumenloom.operators import repair

    rng = np.random.default_rng(11)
    for at, goals, retries in (
        # Both straight ways cross a resting atom; the dearer choice goes around it.
        ([(0.0, 0.0), (10.0, 0.3), (5.0, 0.2), (9.0, 9.0)], [(10.0, 0.0), (0.0, 0.1)], 4),
        (rng.uniform(0, 8, (6, 2)).tolist(), rng.uniform(0, 8, (3, 2)).tolist(), 3),
        # Sites nearer than atoms may stand: no attempt can be clear.
        ([(0.0, 0.0), (5.0, 0.0), (0.0, 9.0)], [(2.0, 2.0), (2.0, 2.1)], 2),
    ):
        atoms = spark.createDataFrame([(k, *map(float, p), 0.0) for k, p in enumerate(at)], "atom_id long, x double, y double, sigma double")
        sites = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(goals)], "site_id long, x double, y double")
        cost = {(a, s): (p[0] - g[0]) ** 2 + (p[1] - g[1]) ** 2 + 1e-3 * a for a, p in enumerate(at) for s, g in enumerate(goals)}
        edges = spark.createDataFrame([(a, s, c) for (a, s), c in cost.items()], "atom_id long, site_id long, cost double")
        plan = repair.direct_ways(atoms, sites, minimum=1.0, margin=0.0, sigmas=0.0)
        found = repair.repaired(edges, plan, retries=retries, penalty=20.0).collect()

        def met(chosen):
            """Pairs whose straight ways, or places, come nearer than 1."""
            legs = {a: (p, goals[chosen.index(a)] if a in chosen else p) for a, p in enumerate(at)}
            t = np.linspace(0, 1, 2001)[:, None]
            line = {a: np.array(p) + (np.array(q) - np.array(p)) * t for a, (p, q) in legs.items()}
            least = lambda a, b: min(np.hypot(*(line[a] - q).T).min() for q in line[b][::4])
            return sum(least(a, b) < 1 for a in legs for b in legs if a < b)

        extra = dict.fromkeys(cost, 0.0)
        for attempt in range(1, retries + 2):
            chosen = min(permutations(range(len(at)), len(goals)), key=lambda c: sum(cost[a, s] + extra[a, s] for s, a in enumerate(c)))
            want = {(a, s, round(cost[a, s] + extra[a, s], 6)) for s, a in enumerate(chosen)}
            if not met(chosen) or attempt > retries:
                break
            for s, a in enumerate(chosen):
                extra[a, s] += 20.0
        assert {(r.atom_id, r.site_id, round(r.cost, 6)) for r in found} == want
        assert {(r.attempt, r.conflicts) for r in found} == {(attempt, met(chosen))}


def test_repaired_assignment_of_the_tables(spark, sf_dir):
    from itertools import permutations

    from lumenloom.operators import repair
    from lumenloom.plans import assembly, views

    cost = {(r.atom_id, r.site_id): r.cost for r in assembly._edges(spark, sf_dir).where("feasible").collect()}
    atoms, sites = sorted({a for a, _ in cost}), sorted({s for _, s in cost})
    plan = repair.direct_ways(views.atoms(spark, sf_dir), views.targets(spark, sf_dir), minimum=0.3, margin=0.0, sigmas=1.0)
    extra = dict.fromkeys(cost, 0.0)
    for attempt in range(1, 5):
        chosen = min((c for c in permutations(atoms, len(sites)) if all(e in cost for e in zip(c, sites))), key=lambda c: sum(cost[e] + extra[e] for e in zip(c, sites)))
        met = plan(spark.createDataFrame(list(zip(chosen, sites)), "atom_id long, site_id long")).count()
        if not met or attempt == 4:
            break
        for e in zip(chosen, sites):
            extra[e] += 50.0
    found = registry.QUERIES["stm_03_repaired_assignment"](spark, sf_dir).collect()
    assert {(r.atom_id, r.site_id) for r in found} == set(zip(chosen, sites))
    assert {(r.attempt, r.conflicts) for r in found} == {(attempt, met)}
    assert sum(r.cost for r in found) == pytest.approx(sum(cost[e] + extra[e] for e in zip(chosen, sites)), abs=1e-4)


def test_a_search_writes_ways_and_not_states(spark, monkeypatch):
    """On an open lattice a way needs no more than the nodes between its ends, whatever the slack."""
    at, links = lattice(10, 10)
    agents = [(k, 100 * (k % 10), 100 * (k % 10) + k // 10 + 6) for k in range(30)]
    written = []

    def counted(df):
        out = cut(df)
        if "agent" in df.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(spacetime, "cut", counted)
    found = ways_of(spacetime.shortest(spark.createDataFrame(agents, "agent long, start long, goal long"), *tables(spark, at, links)))
    assert {a: len(w) - 1 for a, w in found.items()} == {a: goal % 100 for a, _, goal in agents}
    assert sum(written) <= len(agents) + sum(map(len, found.values()))


def test_gaps_are_those_of_the_column_expression(spark):
    from pyspark.sql import functions as F

    from lumenloom.functions.geometry import segment_to_segment

    p = np.random.default_rng(4).integers(0, 6, (8, 3000)).astype(float)
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p.T)], "k int, " + ", ".join(f"c{i} double" for i in range(8)))
    want = [r.d for r in rows.select("k", segment_to_segment(*[(F.col(f"c{i}"), F.col(f"c{i + 1}")) for i in range(0, 8, 2)]).alias("d")).orderBy("k").collect()]
    assert spacetime._gap(*[p[i : i + 2] for i in range(0, 8, 2)]) == pytest.approx(want, abs=1e-9)
