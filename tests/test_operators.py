import itertools
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenloom.functions import geometry, hashing, numeric, optics
from lumenloom.functions.numeric import lit
from lumenloom.operators import assignment, auction, conflicts, frames, joins, order, rasters, selection, validate
from lumenloom.plans import registry, views
from lumenloom.sources import packed, points, tables
from lumenloom.streaming import sequence


def test_known_assignments():
    assert assignment.least_cost(np.array([[4, 1, 3], [2, 0, 5], [3, 2, 2]], float)).tolist() == [1, 0, 2]
    assert assignment.least_cost(np.array([[4, 1, 3], [2, 0, 5]], float)).tolist() == [1, 0]
    assert assignment.least_cost(np.array([[1.0], [2.0]])) is None


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 2), st.data())
def test_assignment_is_optimal(rows, more, data):
    cost = np.array(data.draw(st.lists(st.lists(st.integers(0, 9), min_size=rows + more, max_size=rows + more), min_size=rows, max_size=rows)), float)
    match = assignment.least_cost(cost)
    best = min(cost[np.arange(rows), list(p)].sum() for p in itertools.permutations(range(rows + more), rows))
    assert len(set(match.tolist())) == rows and cost[np.arange(rows), match].sum() == best


def test_infeasible_problem_is_one_row(spark):
    edges = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 2.0), (2, 0, 0, 3.0)], "problem long, row long, col long, cost double")
    got = {(r.problem, r.row, r.col) for r in assignment.solve(edges).collect()}
    assert got == {(1, None, None), (2, 0, 0)}


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    at = rng.uniform(-5, 5, (60, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    got = {(r.a_id, r.b_id) for r in joins.near_pairs(df, df, "id", "id", 1.2, same=True).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if np.hypot(*(at[i] - at[j])) < 1.2}


def test_sampling_takes_the_earlier_segment(spark):
    way = spark.createDataFrame([(1, 1, 0.0, 0.0, 0), (1, 2, 10.0, 0.0, 100), (1, 3, 10.0, 10.0, 200)], "trajectory long, seq int, x double, y double, arrival long")
    times = spark.createDataFrame([(1, 0), (1, 50), (1, 100), (1, 200), (1, 201)], "trajectory long, t long")
    got = {r.t: (r.x, r.y) for r in joins.sample_at(way, times).collect()}
    assert got == {50: (5.0, 0.0), 100: (10.0, 0.0), 200: (10.0, 10.0)}


def test_numeric_edges(spark):
    row = spark.range(1).select(numeric.wrap_phase(lit(-np.pi)).alias("a"), numeric.half_up(lit(-2.5)).alias("b"), numeric.safe_ratio(lit(1), lit(0), lit(7)).alias("c"), hashing.mix32(F.lit(0).cast("long")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (np.pi, -2.0, 7.0, 0)


@pytest.mark.parametrize("p, inside", [((1, 1), True), ((0, 1), True), ((3, 1), False), ((2, 2), True), ((-1, 0), False)])
def test_polygon(spark, p, inside):
    xs, ys = F.array(*map(lit, (0, 2, 2, 0))), F.array(*map(lit, (0, 0, 2, 2)))
    assert spark.range(1).select(geometry.in_polygon((lit(p[0]), lit(p[1])), xs, ys)).first()[0] is inside


def test_segment_distances(spark):
    at = lambda x, y: (lit(x), lit(y))
    row = spark.range(1).select(geometry.segment_to_segment(at(0, 0), at(2, 2), at(0, 2), at(2, 0)), geometry.segment_to_segment(at(0, 0), at(1, 0), at(0, 1), at(1, 1)), geometry.point_to_segment(at(3, 4), at(0, 0), at(0, 0))).first()
    assert tuple(row) == (0.0, 1.0, 5.0)


def test_components_of_a_small_image(spark):
    pixels = [(0, 0), (1, 1), (1, 2), (4, 4), (6, 0), (7, 1), (6, 2)]
    df = spark.createDataFrame([(y, x, 5) for y, x in pixels], "py int, px int, level long")
    got = {(r.py, r.px): r.label for r in rasters.components(df, 8).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (1, 2): 0, (4, 4): 36, (6, 0): 48, (7, 1): 48, (6, 2): 48}


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v == r.number for r in order.numbered(df, ["v"]).collect())
    assert order.numbered(df.where("v < 0"), ["v"]).count() == 0


def test_violations_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 9.0)], "id long, x double")
    got = {tuple(r) for r in validate.violations(df, "id", {"OUT_OF_BOUNDS": F.col("x") < 1}).collect()}
    assert got == {("OUT_OF_BOUNDS", 2), ("OUT_OF_BOUNDS", 3)}


def test_json_points(spark):
    rows = [(1, '[[1, 2], {"xUm": 3, "y": 4, "id": 9}]'), (2, '{"points": [[5, 6]]}'), (3, "[[1]]"), (4, None), (5, "{}")]
    got = sorted((r.k, r.id, r.x, r.y, r.ok) for r in points.json_points(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect() if r.ok)
    assert got == [(1, 1, 1.0, 2.0, True), (1, 9, 3.0, 4.0, True), (2, 1, 5.0, 6.0, True)]


def test_code_tables(spark):
    rows = [(1, "0 1, 2;3"), (2, "[3, 2, 2]"), (3, "1 5 2"), (4, "x"), (5, None)]
    got = {r.k: r.monotone for r in points.code_table(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_packed_frames(spark):
    traps = spark.createDataFrame([(0, 0, 5, None, 1.0, 2.0, 0.5, -1.0, 3), (0, 0, 2, 4294967295, 0.0, 0.0, 1.0, 0.0, 0), (1, 100, 2, 7, 0.5, 0.0, 1.0, 0.0, 1)], "frame long, time long, trap_id long, atom_id long, x double, y double, intensity double, phase double, flags long")
    blobs = packed.pack_frames(traps)
    assert {r.frame: len(r.bytes) for r in blobs.collect()} == {0: 16 + 90, 1: 16 + 45}
    back = {tuple(r)[:-1] for r in packed.unpack_frames(blobs).collect()}
    assert back == {tuple(r) for r in traps.collect()}
    cut = blobs.select(F.expr("substring(bytes, 1, length(bytes) - 1)").alias("bytes"))
    assert {r.error for r in packed.unpack_frames(cut).collect()} == {"STORAGE_ERROR"}


def test_bitmap_round_trip(spark):
    codes = [(1, y, x, (y * 37 + x * 11) % 256) for y in range(3) for x in range(5)]
    df = spark.createDataFrame(codes, "k long, y int, x int, code int")
    assert {tuple(r) for r in packed.pixels(packed.bitmaps(df, "k"), "k").collect()} == set(codes)


def test_crc_vector(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary"))).first()[0] == zlib.crc32(b"123456789") == 0xCBF43926


def test_streaming_state_survives_replay(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    schema = "trap_id long, frame long, phase double"
    spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.5), (2, 0, 1.0)], schema).write.parquet(str(src))

    def run():
        stream = sequence.carried_phase(spark.readStream.schema(schema).parquet(str(src)))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([(1, 1, 9.0), (1, 2, 3.5), (2, 1, 0.0)], schema).write.mode("append").parquet(str(src))
    run()
    got = {tuple(r) for r in spark.read.parquet(str(out)).collect()}
    assert got == {(1, 0, None), (1, 1, 1.0), (2, 0, None), (1, 2, 2.0), (2, 1, -1.0)}


def test_closest_pairs_of_all_traps(spark):
    rng = np.random.default_rng(4)
    sets = [rng.random((60, 2)) * 100, rng.random((300, 2)) ** 8 * 100, np.array([[1.0, 2.0], [5.0, 5.0], [1.0, 2.0]]), np.array([[0.0, 0.0], [0.0, 7.0]]), np.array([[3.0, 3.0]])]
    rows = [(k, n, float(x), float(y)) for k, s in enumerate(sets) for n, (x, y) in enumerate(s)]
    got = {r.frame: (r.least, r.n_pairs) for r in frames.closest(spark.createDataFrame(rows, "frame long, trap_id long, x double, y double")).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for k, s in enumerate(sets[:4]):
        d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(axis=2))[np.triu_indices(len(s), 1)]
        assert abs(got[k][0] - d.min()) < 1e-9 and got[k][1] == len(d)


def test_separation_of_all_traps_of_the_tables(spark, sf_dir):
    wanted = {r.frame: (r.least, r.n_pairs) for r in frames.separation(views.trap_frames(spark, sf_dir)).collect()}
    got = {r.frame: (r.least, r.n_pairs) for r in registry.join_21_frame_separation(spark, sf_dir).collect()}
    assert set(got) == set(wanted) and all(abs(got[k][0] - v[0]) < 1e-6 and got[k][1] == v[1] for k, v in wanted.items())


def test_crossings_of_all_paths(spark, sf_dir):
    s = joins.segments(views.ways(spark, sf_dir)).select("trajectory", "seq", "x", "y", "x_end", "y_end")
    o = s.toDF("o_trajectory", "seq", "o_x", "o_y", "o_x_end", "o_y_end")
    at = lambda p, e="": (F.col(f"{p}x{e}"), F.col(f"{p}y{e}"))
    hit = geometry.segments_cross(at(""), at("", "_end"), at("o_"), at("o_", "_end"))
    every = s.join(o, ["seq"]).where("trajectory < o_trajectory").where(hit).groupBy("trajectory", "o_trajectory").agg(F.min("seq"), F.count("*"))
    wanted = {tuple(r) for r in every.collect()}
    assert {tuple(r) for r in registry.join_12_path_conflicts(spark, sf_dir).collect()} == wanted
    assert any(b > a + 3 for a, b, *_ in wanted)


def test_conflicts_know_paths_at_rest(spark):
    """1 and 2 change places; 3 has come to rest in the way of 4, which passes it later; 5 and 6 stay put."""
    rows = [(1, 0, 0, 0), (1, 1, 4, 0), (2, 0, 4, 0), (2, 1, 0, 0), (3, 0, 20, 9), (3, 1, 20, 0), (4, 0, 30, 0), (4, 1, 30, 0), (4, 2, 26, 0), (4, 3, 14, 0), (5, 0, 50, 50), (6, 0, 50.5, 50), (7, 0, 60, 50)]
    ways = spark.createDataFrame([(a, b, float(c), float(d), 0.0) for a, b, c, d in rows], "trajectory long, tick int, x double, y double, sigma double")
    got = {tuple(r) for r in conflicts.conflicts(ways, minimum=1.0, margin=0.0, sigmas=1.0).collect()}
    assert got == {(1, 2, 0, "edge"), (3, 4, 2, "near-edge"), (5, 6, 0, "vertex")}


def test_code_tables_of_whole_vectors(spark, tmp_path):
    rise = [float(k) for k in range(64)]
    spark.createDataFrame([(1, rise), (2, rise[:20] + rise[:44]), (3, rise[::-1])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n, r.monotone) for r in registry.src_05_code_tables(spark, str(tmp_path)).collect()}
    assert got == {1: (64, True), 2: (64, False), 3: (64, True)}


# --- hashes, streams, payloads, tables ----------------------------------------------------------


def test_known_hashes_and_streams(spark):
    row = spark.range(1).select(hashing.hex32(hashing.fnv1a32(F.lit(""))).alias("a"), hashing.hex32(hashing.fnv1a32(F.lit("a"))).alias("b"), hashing.hex32(hashing.fnv1a32(F.lit("foobar"))).alias("c"), hashing.fnv1a32(F.lit("\U0001f600")).alias("d")).first()
    wide = 2166136261
    for unit in (0xD83D, 0xDE00):
        wide = (wide ^ unit) * 16777619 % (1 << 32)
    assert tuple(row) == ("811c9dc5", "e40c292c", "bf9cf968", wide)
    got = [r.v for r in spark.range(8).orderBy("id").select(hashing.stream32(F.lit(0x12345678).cast("long"), F.col("id")).alias("v")).collect()]
    assert got == [455919406, 4042750857, 4036713555, 1004527575, 3885174651, 3342903291, 1200158424, 1464636653]


def test_broken_payloads_name_their_error(spark):
    import struct

    rows = spark.createDataFrame([(7, 3, 2, 2, [(1.0, 2.0, 0.5, 4)], [1, 2, 3, 4], '{"a":1}')], "sample_id long, seed long, width int, height int, traps array<struct<x:float,y:float,phase:float,trap_id:long>>, codes array<int>, metrics string")
    whole = bytes(packed.pack_samples(rows).first().bytes)
    assert len(whole) == 64 + 8 + 4 + 4 + 4 + 7
    cases = {"ok": whole, "SHORT": whole[:20], "HEADER": b"X" + whole[1:], "LENGTH": whole + b" ", "CRC32": whole[:80] + b"\x09" + whole[81:], "METRICS": whole[:52] + struct.pack("<I", 13) + whole[56:84] + b'{"a":1,"a":2}', "SECTIONS": whole[:16] + struct.pack("<I", 2) + whole[20:]}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "name string, bytes binary")
    for name in cases:
        got = packed.unpack_samples(df.where(F.col("name") == name)).first()
        assert got.error == (None if name == "ok" else name)
    assert packed.unpack_samples(df.where("name = 'ok'")).first().sample_id == 7


STRICT = {
    "[0, 1, 6]": ([0, 1, 6], None), '{"phases": [3, 2, 2]}': ([3, 2, 2], None), "\ufeff0 1\n2 3\n": ([0, 1, 2, 3], None), "# c\n0.5;1.5;2\n": ([0.5, 1.5, 2], None),
    "Measured_Phase,note\n1,a\n2,b\n": ([1, 2], None), "Measured_Phase\n1\n2\n": (None, "INVALID"), "": (None, "EMPTY"), "0,x": (None, "INVALID"), '{"values": [0, 1], "phases": [0, 1]}': (None, "INVALID"), "note,other\n1,2\n": (None, "INVALID"),
    "0,0\n254,1\n": (None, "INVALID"), "0,0\n255,1\n300,2\n": (None, "INVALID"), "5": ([5], "LENGTH"), "1 1 1": ([1, 1, 1], "ZERO_SPAN"), "0 2 1 3": ([0, 2, 1, 3], "REVERSES"), "0 1 Infinity": ([0, 1, float("inf")], "NOT_FINITE"),
}


def test_strict_tables(spark):
    from lumenloom.sources import tables

    df = spark.createDataFrame([(k, t) for k, t in enumerate(STRICT)], "k long, t string")
    got = {r.k: (r["values"], r.error) for r in tables.strict_tables(df, "k", "t").collect()}
    assert [got[k] for k in range(len(STRICT))] == [tuple(v) for v in STRICT.values()]


def test_bitmaps_of_other_depths(spark):
    head = lambda bits, h: b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + h.to_bytes(4, "little", signed=True) + b"\1\0" + bytes([bits, 0]) + bytes(24)
    rows = [(1, bytearray(head(24, 2) + bytes([0, 0, 255, 0, 255, 0, 0, 0]))), (2, bytearray(head(32, -2) + bytes([0, 0, 255, 0, 255, 0, 0, 0]))), (3, bytearray(head(16, 2) + bytes(8)))]
    got = {tuple(r) for r in packed.pixels(spark.createDataFrame(rows, "k long, bytes binary"), "k").collect()}
    assert got == {(1, 1, 0, 54), (1, 0, 0, 18), (2, 0, 0, 54), (2, 1, 0, 18)}


# --- order-dependent work -----------------------------------------------------------------------


def matrix_of(edges, atom="atom_id", site="site_id"):
    rows = edges.collect()
    sites, atoms = sorted({r[site] for r in rows}), sorted({r[atom] for r in rows})
    cost = np.full((len(sites), len(atoms)), 1e30)
    for r in rows:
        cost[sites.index(r[site]), atoms.index(r[atom])] = r.cost
    return cost


def test_total_of_the_assignment_is_least(spark, sf_dir):
    cost = matrix_of(registry._matrix(spark, sf_dir))
    best = cost[np.arange(len(cost)), assignment.least_cost(cost)].sum()
    solved = registry.gen_12_assignment(spark, sf_dir).collect()
    assert len({r.atom_id for r in solved}) == len({r.site_id for r in solved}) == len(solved) == len(cost)
    assert abs(sum(r.cost for r in solved) - best) < 1e-4
    total = registry.QUERIES["agg_02_assignment_cost"](spark, sf_dir).first()
    assert abs(total.total - best) < 1e-4 and total.n_sites == len(cost)


@pytest.mark.parametrize("patience", [0, 3, 12])
def test_sites_that_compete_for_few_atoms(spark, patience):
    rng = np.random.default_rng(5 + patience)
    cost = np.round(rng.uniform(0, 4, (5, 8))) + (np.arange(8) > 2) * 50
    cost[rng.random((5, 8)) < 0.15] = 1e30
    edges = spark.createDataFrame([(j, i, float(cost[i, j])) for i in range(5) for j in range(8) if cost[i, j] < 1e29], "atom_id long, site_id long, cost double")
    atoms = spark.createDataFrame([(j, 0.0, 0.0) for j in range(8)], "atom_id long, x double, y double")
    got = auction.fill_sites(edges, atoms, patience=patience).collect()
    best = cost[np.arange(5), assignment.least_cost(cost)].sum()
    filled = [r for r in got if r.site_id is not None]
    assert len(got) == 8 and len({r.atom_id for r in filled}) == len(filled) == 5 and sum(r.cost for r in filled) == best


def test_parking_places_have_room_for_their_share(spark, monkeypatch):
    """Two sites, five atoms, two parking places: three atoms park, two of them at the first place."""
    at = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (9.0, 0.0), (10.0, 0.0)]
    atoms = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "atom_id long, x double, y double")
    parking = spark.createDataFrame([(0, 1.0, 1.0), (1, 9.0, 2.0)], "spot long, x double, y double")
    sites = [(0.0, 1.0), (5.0, 0.0)]
    gap = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
    edges = spark.createDataFrame([(a, s, gap(p, q)) for a, p in enumerate(at) for s, q in enumerate(sites)], "atom_id long, site_id long, cost double")
    places = [*sites, (1.0, 1.0), (1.0, 1.0), (9.0, 2.0)]
    best = min(sum(gap(at[a], places[k]) for k, a in enumerate(choice)) for choice in itertools.permutations(range(5)))
    for rows in (auction.WINDOW_ROWS, 0):
        monkeypatch.setattr(auction, "WINDOW_ROWS", rows)
        got = auction.fill_sites(edges, atoms, parking=parking, resolution=1.0).collect()
        assert sum(r.cost for r in got) == best and sorted(r.spot for r in got if r.spot is not None) == [0, 0, 1]


def test_infeasible_assignments(spark):
    atoms = spark.createDataFrame([(j, 0.0, 0.0) for j in range(3)], "atom_id long, x double, y double")
    few = spark.createDataFrame([(0, s, 1.0 + s) for s in range(2)], "atom_id long, site_id long, cost double")
    with pytest.raises(auction.Infeasible):
        auction.fill_sites(few, atoms, patience=2)
    with pytest.raises(auction.Infeasible):
        auction.fill_sites(few, atoms.limit(1))


def test_dispositions(spark, sf_dir):
    rows = registry.QUERIES["gen_13_dispositions"](spark, sf_dir).collect()
    atoms = {r.atom_id: r.movable for r in views.atoms(spark, sf_dir).collect()}
    left = {"KEEP": "KEEP", "RELEASE_IN_PLACE": "RELEASE", "PARK": "PARK", "PARK_AND_RELEASE": "PARK"}
    for policy, name in left.items():
        mine = [r for r in rows if r.policy == policy]
        assert [r.atom_id for r in sorted(mine, key=lambda r: r.source_index)] == sorted(atoms)
        assert all(r.disposition in ("MOVE_TO_TARGET", "STAY") if r.site_id is not None else r.disposition == (name if atoms[r.atom_id] else "STAY") for r in mine)
        assert len({r.site_id for r in mine if r.site_id is not None}) == sum(r.site_id is not None for r in mine) > 0


def test_resampling_of_a_known_path(spark):
    from lumenloom.operators import paths

    way = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 0.0), (1, 3, 3.0, 4.0), (2, 1, 5.0, 5.0)], "k long, seq int, x double, y double")
    got = [(r.k, r.x, r.y) for r in paths.resampled(way, "k", 2.5).orderBy("k", "n").collect()]
    assert got == [(1, 0.0, 0.0), (1, 2.5, 0.0), (1, 3.0, 2.0), (2, 5.0, 5.0)]


def test_resampling_of_random_paths(spark):
    """Against a walk in decimal steps: every sample lies on the path, a spacing of way behind the last."""
    from lumenloom.operators import paths

    rng = np.random.default_rng(4)
    rows = [(k, n, float(x), float(y)) for k in range(40) for n, (x, y) in enumerate(np.round(rng.uniform(0, 20, (int(rng.integers(1, 9)), 2)), 3))]
    rows += [(k, n, x, y) for k, n, x, y in [(50, 0, 1.0, 1.0), (50, 1, 1.0, 1.0), (50, 2, 1.0, 9.0), (50, 3, 1.0, 1.0)]]
    way = spark.createDataFrame(rows, "k long, seq int, x double, y double")
    got = {}
    for r in paths.resampled(way, "k", 2.5).orderBy("k", "n").collect():
        got.setdefault(r.k, []).append((r.n, r.x, r.y))
    for k in {r[0] for r in rows}:
        corners = np.array([r[2:] for r in rows if r[0] == k])
        lengths = np.hypot(*np.diff(corners, axis=0).T)
        far = np.concatenate(([0], np.cumsum(lengths)))
        assert [n for n, *_ in got[k]] == list(range(len(got[k]))) and abs(len(got[k]) - 1 - far[-1] / 2.5) <= 1 + 1e-6
        for n, x, y in got[k]:
            assert abs(x - np.interp(2.5 * n, far, corners[:, 0])) < 1e-4 and abs(y - np.interp(2.5 * n, far, corners[:, 1])) < 1e-4


def in_order(rows, dx, dy, inclusive=False, digits=None, existing=(), at_most=None):
    kept, out = [tuple(round(v, digits) if digits else v for v in e) for e in existing], []
    for k, x, y in rows:
        if at_most is not None and len(kept) >= at_most:
            break
        gaps = [np.hypot((x - a) / dx, (y - b) / dy) for a, b in kept]
        if all(g > 1 if inclusive else g >= 1 for g in gaps):
            kept.append((round(x, digits), round(y, digits)) if digits else (x, y))
            out.append(k)
    return out


@pytest.mark.parametrize("options", [{}, {"inclusive": True}, {"digits": 1, "existing": [(5.0, 5.04), (5.0, 5.0)], "at_most": 40}])
def test_greedy_selection(spark, options):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.round(rng.uniform(0, 10, (160, 2)), 2))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    more = dict(options)
    if "existing" in more:
        more["existing"] = spark.createDataFrame(more["existing"], "x double, y double")
    got = selection.apart(df, [F.col("id")], 1.5, 0.8, **more).orderBy("place").collect()
    assert [r.id for r in got] == in_order(rows, 1.5, 0.8, **options)
    assert selection.apart(df.where("false"), [F.col("id")], 1.5, 0.8).count() == 0


def test_selections_over_whole_tables(spark, sf_dir):
    at = views.points(spark, sf_dir).collect()
    hashed = sorted(((r.point_id, r.x, r.y) for r in at), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    got = [r.point_id for r in registry.QUERIES["srt_06_merged_points"](spark, sf_dir).orderBy("place").collect()]
    assert got == in_order(hashed, 3.2, 3.2, inclusive=True) and len(got) < len(at)
    found = registry.QUERIES["srt_04_resolvable"](spark, sf_dir).collect()
    way = views.ways(spark, sf_dir).withColumn("s", F.pmod(F.xxhash64("trajectory", "seq"), F.lit(1000))).collect()
    rows = [((r.trajectory, r.seq), r.x, r.y) for r in sorted(way, key=lambda r: (-r.s, r.trajectory, r.seq))]
    assert {(r.trajectory, r.seq) for r in found} == set(in_order(rows, 2.0, 3.0))
    fixed = [(r.x, r.y) for r in views.atoms(spark, sf_dir).where("not movable").collect()]
    got = [r.point_id for r in registry.QUERIES["srt_05_appended_points"](spark, sf_dir).orderBy("place").collect()]
    assert got == in_order(hashed, 4.0, 4.0, digits=6, existing=fixed, at_most=2000)


def first_unproven(paths, safe, depth):
    """The intervals between breakpoints of each pair, searched one by one from left to right."""
    top = max(p[-1][0] for p in paths.values())

    def at(way, t):
        if t <= way[0][0]:
            return np.array(way[0][1:])
        for (t0, *a), (t1, *b) in zip(way, way[1:]):
            if t <= t1:
                u = (t - t0) / (t1 - t0)
                return np.array(a) + (np.array(b) - np.array(a)) * (10 * u**3 - 15 * u**4 + 6 * u**5)
        return np.array(way[-1][1:])

    def speed(way, lo, hi):
        return next((1.875 * np.hypot(b[1] - a[1], b[2] - a[2]) / (b[0] - a[0]) for a, b in zip(way, way[1:]) if a[0] <= lo and hi <= b[0]), 0.0)

    found = {}
    for a in sorted(paths):
        for b in sorted(k for k in paths if k > a):
            cuts = sorted({0.0, top, *[w[0] for k in (a, b) for w in paths[k]]})
            for lo, hi in zip(cuts, cuts[1:]):
                met = []

                def clear(lo, hi, level):
                    gaps = [np.hypot(*(at(paths[a], t) - at(paths[b], t))) for t in (lo, (lo + hi) / 2, hi)]
                    met.append(min(gaps))
                    if min(met) < safe - 1e-9:
                        return False
                    if gaps[1] > safe + (speed(paths[a], lo, hi) + speed(paths[b], lo, hi)) * (hi - lo) / 2 + 1e-9:
                        return True
                    return level < depth and clear(lo, (lo + hi) / 2, level + 1) and clear((lo + hi) / 2, hi, level + 1)

                if not clear(lo, hi, 0):
                    found[a, b] = (lo, hi, round(min(met), 6))
                    break
    return found


def test_clearance_over_merged_breakpoints(spark):
    from lumenloom.operators import clearances

    rng = np.random.default_rng(3)
    paths = {k: list(zip(np.cumsum(rng.uniform(1, 40, n)).tolist(), rng.uniform(0, 14, n).tolist(), rng.uniform(0, 14, n).tolist())) for k, n in enumerate(rng.integers(1, 6, 24))}
    # One that starts at once and then stays for very long, next to one that passes late.
    paths[100] = [(0.0, 3.0, 3.0), (2.0, 4.0, 3.0)]
    paths[101] = [(9000.0, 0.0, 3.1), (9040.0, 9.0, 3.1)]
    rows = [(k, n, x, y, t, 0.05) for k, w in paths.items() for n, (t, x, y) in enumerate(w)] + [(7, 99, None, 1.0, 5.0, 0.0)]
    way = spark.createDataFrame(rows, "trajectory long, seq int, x double, y double, arrival double, sigma double")
    for depth in (3, 12):
        found = clearances.unproven(way, minimum=0.3, margin=0.1, sigmas=1.0, depth=depth).collect()
        assert {(r.a_id, r.b_id): (r.start, r.stop, round(r.least, 6)) for r in found} == first_unproven(paths, 0.5, depth)
    assert (100, 101) in {(r.a_id, r.b_id) for r in found}


def test_a_swap_between_waypoints_is_found(spark):
    from lumenloom.operators import clearances

    schema = "trajectory long, seq int, x double, y double, arrival long, sigma double"
    swap = [(1, 0, 0.0, 0.0, 0, 0.0), (1, 1, 8.0, 0.0, 100, 0.0), (2, 0, 8.0, 0.0, 0, 0.0), (2, 1, 0.0, 0.0, 140, 0.0)]
    apart = [(r[0], r[1], r[2], r[3] + (5.0 if r[0] == 2 else 0.0), *r[4:]) for r in swap]
    run = lambda rows: clearances.unproven(spark.createDataFrame(rows, schema), minimum=1.0, margin=0.0, sigmas=0.0).collect()
    assert [(r.a_id, r.b_id, r.start, r.stop) for r in run(swap)] == [(1, 2, 0.0, 100.0)]
    assert run(apart) == [] and run(swap[:1]) == [] and run([]) == []


def test_issues_of_a_sequence(spark):
    from lumenloom.operators import sequences

    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    way = t([(1, 1, 0, 0.0, 0.0, 0, 0.0), (1, 1, 1, 5.0, 0.0, 100, 0.0), (2, 2, 0, 5.0, 9.0, 0, 0.0), (3, 3, 0, 5.0, 9.5, 0, 0.0)], "trajectory long, trap_id long, seq int, x double, y double, arrival long, sigma double")
    sites = t([(10, 5.0, 0.0, True, None), (11, 5.0, 9.0, True, 0.5), (12, 0.0, 30.0, True, 1.0), (13, 0.0, 40.0, None, 1.0)], "site_id long, x double, y double, required boolean, final_intensity double")
    assigned = t([(1, 10), (2, 11), (3, 11), (4, 99), (5, None)], "atom_id long, site_id long")
    frames = t([(0, 1, 1, 1.0), (1, 1, 1, 1.0), (1, 2, 2, 0.5), (1, 3, None, 0.5)], "frame long, trap_id long, atom_id long, intensity double")
    shown = t([(0,), (1,), (1,), (2,)], "frame long")
    metrics = t([(0, True, True, True), (1, True, True, None), (2, True, None, True)], "frame long, valid boolean, accepted boolean, converged boolean")
    limits = dict(minimum=1.0, margin=0.0, sigmas=0.0)
    found = {tuple(r) for r in sequences.issues(assigned, sites, way, frames, shown, metrics, **limits).collect()}
    assert found == {
        ("error", "ASSIGNMENT_INFEASIBLE", None, None, 11, None, 2.0),
        ("error", "ASSIGNMENT_INFEASIBLE", None, None, 12, None, 0.0),
        ("error", "FRAME_COUNT_MISMATCH", None, None, None, 1, 2.0),
        ("error", "FRAME_COUNT_MISMATCH", None, None, None, 2, 1.0),
        ("error", "FINAL_POSITION_MISMATCH", 3, None, 11, None, 0.5),
        ("error", "ILLEGAL_LIFECYCLE", 3, None, 11, None, 0.5),
        ("warning", "WGS_NOT_CONVERGED", None, None, None, 1, None),
        ("error", "FRAME_QUALITY_REJECTED", None, None, None, 2, None),
        ("error", "COLLISION_VALIDATION_FAILED", 2, 3, None, None, 0.5),
    }
    none = [d.limit(0) for d in (assigned, sites, way, frames, shown, metrics)]
    assert sequences.issues(*none, **limits).collect() == []


def test_adaptive_bins(spark, sf_dir):
    found = registry.QUERIES["srt_03_adaptive_bins"](spark, sf_dir).collect()
    assert len(found) <= 60 and len({r.spacing for r in found}) == 1


def test_components_of_links(spark):
    from lumenloom.operators import graphs

    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (7, 9)], "a long, b long")
    assert {tuple(r) for r in graphs.components(links, "a", "b").collect()} == {(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 7)}


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 5).alias("v"))
    values = {r.k: r.v for r in df.collect()}
    for r in order.running(df, ["k"], "v", "before").collect():
        assert r.before == sum(values[k] for k in range(r.k))
    assert {r.k: r.was for r in order.previous(df, "k", "v", "was").collect()} == {k: values.get(k - 1) for k in values}


def test_every_sample_is_appended_once(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    schema = "sample_id long, ts timestamp"
    write = lambda ids: spark.createDataFrame([(k,) for k in ids], "sample_id long").withColumn("ts", F.timestamp_seconds(F.lit(1000) + F.col("sample_id"))).write.mode("append").parquet(str(src))
    for ids in ((1, 2, 2, 3), (2, 3, 4)):
        write(ids)
        stream = sequence.once(spark.readStream.schema(schema).parquet(str(src)))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.sample_id for r in spark.read.parquet(str(out)).collect()) == [1, 2, 3, 4]


def test_shards_are_written_and_resumed(spark, tmp_path):
    from lumenloom.sources import shards

    samples = spark.range(10).select((F.col("id") * 3).alias("sample_id"), F.lit("x").alias("body"))
    listed = shards.write(samples.where("sample_id < 21"), "sample_id", 3, f"{tmp_path}/data")
    assert [(r.n, r.first_id, r.full_shard) for r in listed.orderBy("shard").collect()] == [(3, 0, True), (3, 9, True), (1, 18, False)]
    left = shards.missing(spark.read.parquet(f"{tmp_path}/data/samples"), samples, "sample_id")
    assert sorted(r.sample_id for r in left.collect()) == [21, 24, 27]


def test_fans_of_long_segments(spark):
    draw = random.Random(5)
    starts = [(i, draw.uniform(-40, 40), draw.uniform(-40, 3000) if i % 2 else draw.uniform(-40, 40)) for i in range(300)] + [(900, 5.0, 5.0), (901, 5.1, 5.0)]
    ends = [(1, 5.0, 5.0), (2, -20.0, 0.0), (3, 5.0, 40.0)]
    stops = [(draw.uniform(-40, 40), draw.uniform(-40, 3000) if i % 2 else draw.uniform(-40, 40)) for i in range(250)] + [(-30.0, 0.0), (-1000.0, 0.0), (5.0, 39.8), (None, 1.0)]
    e = spark.createDataFrame(ends, "site_id long, x_end double, y_end double")
    parts = spark.createDataFrame(starts, "atom_id long, x double, y double").crossJoin(e)
    fans = joins.fans_near(parts, e, spark.createDataFrame(stops, "x double, y double"), ["atom_id", "site_id"], "site_id", 0.4)
    cells, rows = 0, fans.collect()

    def gap(p, a, b):
        size = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / size)) if size else 0.0
        return math.hypot(p[0] - a[0] - (b[0] - a[0]) * t, p[1] - a[1] - (b[1] - a[1]) * t)

    assert {(r.atom_id, r.site_id) for r in rows} == {(i, k) for i, *a in starts for k, *b in ends if any(p[0] is not None and gap(p, a, b) < 0.4 for p in stops)}
    assert 100 < len(rows) == len(set(rows)) < len(starts) * len(ends)


def test_edges_over_a_long_plane(spark):
    """By the cells of their boxes, these two segments alone would stand in some 10^10."""
    atoms = spark.createDataFrame([(1, 1e5, 1e5, 0), (2, 1e5, 0.0, 0)], "atom_id long, x double, y double, grp int")
    sites = spark.createDataFrame([(7, 0.0, 0.0, -1, -1, False)], "site_id long, x double, y double, required_atom int, required_group int, forbid boolean")
    none = spark.createDataFrame([], "atom_id long, site_id long, penalty double")
    found = joins.edge_costs(atoms, sites, spark.createDataFrame([(5e4, 5e4)], "x double, y double"), none, lambda a, b: F.lit(False))
    assert {r.atom_id: r.cost for r in found.collect()} == pytest.approx({1: 2e10 + 100, 2: 1e10})


def test_cover_keeps_few_edges(spark):
    draw = random.Random(2)
    rows = [(p, o, float(draw.randrange(40))) for p in range(4) for o in range(300)]
    edges = spark.createDataFrame(rows, "person long, object long, cost double")
    few = auction._cheapest(edges.withColumnRenamed("cost", "units"), 5)
    assert {(r.person, r.object) for r in few.collect()} == {(p, o) for p in range(4) for _, o in sorted((c, o) for q, o, c in rows if q == p)[:5]}
    cost = {(p, o): c for p, o, c in rows}
    near = [sorted((cost[p, o], o) for o in range(300))[:5] for p in range(4)]
    least = min(sum(c for c, _ in pick) for pick in itertools.product(*near) if len({o for _, o in pick}) == 4)
    assert sum(cost[r.person, r.object] for r in auction.cover(edges).collect()) == least


def test_nearest_spans(spark):
    draw = random.Random(4)
    rows = [(i, [round(draw.uniform(-4, 4), 1) for _ in range(draw.randrange(1, 7))]) for i in range(60)] + [(90, [0.0, 0.0, 1.0]), (91, [9.0, -9.0]), (92, [-0.5, 0.5])]
    at = lambda k: k / lit(40) * lit(6) - lit(3)
    t = spark.createDataFrame(rows, "k long, t array<double>")
    spans = t.select("k", F.inline(optics.nearest_spans(F.col("t"), at, 41))).collect()
    every = t.select("k", "t", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("i")).select("k", "i", optics.nearest_entry(at(F.col("i")), F.col("t")).alias("code")).collect()
    assert {(r.k, i, r["index"]) for r in spans for i in range(r.first, r.last + 1)} == {(r.k, r.i, r.code) for r in every}
    plan = registry.QUERIES["sca_40_inverse_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan, "entries must not become rows"


def test_code_axis_binds_its_tables(spark):
    df = spark.createDataFrame([([0, 3, 255], [0.0, 1.5, 6.0]), ([0, 255], [2.0, 1.0]), ([0, 3, 3, 255], [0.0] * 4), ([1, 255], [0.0, 1.0])], "c array<int>, p array<double>")
    axis = tables.code_axis(F.col("c"), F.col("p"))
    got = [r[0] for r in df.select(axis).collect()]
    assert got[2] is None and got[3] is None
    for v, c, p in ((got[0], [0, 3, 255], [0.0, 1.5, 6.0]), (got[1], [0, 255], [2.0, 1.0])):
        assert v == pytest.approx(np.interp(range(256), c, p).tolist())
    assert str(axis._jc.toString()).count("p AS phases") == 1, "the phases are named once, not for every use"


def test_many_traps_in_one_place(spark):
    """By pairs these would be 2 * 10^9."""
    many = spark.range(60_000).select(F.lit(1).alias("frame"), (F.col("id") + 5).alias("trap_id"), lit(1).alias("x"), lit(2).alias("y"))
    some = spark.createDataFrame([(1, 3, 60.0, 60.0), (1, 4, 60.1, 60.0), (1, 1, 1.0, 2.5), (2, 8, 0.0, 0.0), (2, 9, 0.5, 0.0), (3, 7, None, 1.0), (3, 8, None, 1.0)], "frame int, trap_id long, x double, y double")
    found = {r.frame: r for r in frames.mode_overlap(many.unionByName(some), scale=10.0, active=8, extent=64).collect()}
    assert (found[1].worst, found[1].a_id, found[1].b_id, found[1].n_close) == (1.0, 5, 6, 60_000 * 59_999 // 2 + 60_000 + 1)
    assert (found[2].a_id, found[2].b_id, found[2].n_close) == (8, 9, 1) and found[3].n_close == 0


def test_near_pairs_copies_few_points(spark, sf_dir):
    draw = random.Random(8)
    rows = [(i, draw.randrange(-40, 40) / 2, draw.randrange(-40, 40) / 2) for i in range(200)] + [(500, None, 1.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    pairs = joins.near_pairs(p, p, "id", "id", 1.5, same=True)
    assert sorted((r.a_id, r.b_id) for r in pairs.collect()) == sorted((a[0], b[0]) for a, b in itertools.combinations(rows[:-1], 2) if math.dist(a[1:], b[1:]) < 1.5)
    assert "sequence(" in pairs._jdf.queryExecution().optimizedPlan().toString(), "a point stands only in cells within reach"
    assert "Generate" not in registry.QUERIES["gen_04_lattice"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_conflicts_compare_boxes_first(spark):
    ways = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 9.0, 0.0, 0.0), (2, 0, 0.0, 1.0, 0.0), (2, 1, 9.0, 1.0, 0.0), (3, 0, 0.0, 2.0, 0.0), (3, 1, 9.0, 2.0, 0.0)], "trajectory long, tick int, x double, y double, sigma double")
    found = conflicts.conflicts(ways, minimum=1.5, margin=0.0, sigmas=0.0)
    assert sorted((r.a_id, r.b_id, r.tick, r.kind) for r in found.collect()) == [(1, 2, 0, "vertex"), (2, 3, 0, "vertex")]
    assert "greatest(least(p_x" in found._jdf.queryExecution().optimizedPlan().toString(), "boxes apart are told without distances"


def test_components_send_no_side_through_the_driver(spark, monkeypatch):
    from lumenloom.operators import graphs
    from lumenloom.operators.lineage import cut

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graphs, "cut", seen)
    links = spark.createDataFrame([(3, 4), (4, 5), (7, 8), (9, 8), (5, 1)], "a long, b long")
    assert {tuple(r) for r in graphs.components(cut(links), "a", "b").collect()} == {(1, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 7)}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_points_that_keep_apart_stand_in_few_cells(spark):
    """A later point met earlier ones in nine cells each."""
    p = spark.range(4000).select(F.col("id").alias("place"), (F.rand(3) * 200).alias("x"), (F.rand(5) * 200).alias("y")).collect()
    df = spark.createDataFrame(p)
    pairs = selection._too_near(df, df, 2.0, 3.0, False)
    at = np.array([(r.x / 2, r.y / 3) for r in p])
    near = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)) < 1
    assert {tuple(r) for r in pairs.collect()} == {(int(i), int(j)) for i, j in np.argwhere(near) if i < j}
    whole = selection._too_near(df.limit(0), df, 2.0, 3.0, False)
    assert "explode(array(" not in whole._jdf.queryExecution().analyzed().toString()
