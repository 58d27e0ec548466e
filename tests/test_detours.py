"""Detour points against a plain computation."""

import math

import pytest

from lumenloom.operators import paths


@pytest.mark.parametrize("around", [[(0.0, 0.0), (9.0, 4.0), (3.0, -2.0)], []])
def test_ten_places_from_the_shortest_way_on(spark, around):
    moves = [(1, 1.0, 1.0, 6.0, 2.0), (2, -5.0, 0.0, 12.0, 8.0), (3, 2.0, 2.0, 2.0, 2.0)]
    found = paths.detours(spark.createDataFrame(moves, "id long, x double, y double, tx double, ty double"), "id", spark.createDataFrame(around, "x double, y double"), 2.0, 0.5).collect()
    for k, x, y, tx, ty in moves:
        xs, ys = ([p[i] for p in [*around, (x, y), (tx, ty)]] for i in (0, 1))
        left, right, low, high = min(xs) - 8.5, max(xs) + 8.5, min(ys) - 8.5, max(ys) + 8.5
        mx, my, cx, cy = (x + tx) / 2, (y + ty) / 2, (left + right) / 2, (low + high) / 2
        spots = [(left, low), (left, high), (right, low), (right, high), (cx, low), (cx, high), (left, cy), (right, cy), (mx, my + 4), (mx, my - 4)]
        way = [round(math.dist((x, y), s) + math.dist(s, (tx, ty)), 6) for s in spots]
        rows = sorted((r for r in found if r["id"] == k), key=lambda r: r["place"])
        assert [r["place"] for r in rows] == list(range(1, 11))
        assert [r["k"] for r in rows] == sorted(range(10), key=lambda i: way[i])
        assert [(r["ox"], r["oy"]) for r in rows] == [pytest.approx(spots[r["k"]]) for r in rows]
        assert [r["length"] for r in rows] == pytest.approx([way[r["k"]] for r in rows], abs=2e-6)
