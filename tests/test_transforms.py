"""Transforms in blocks against direct sums."""

import cmath
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenloom.operators import fields, transforms


def direct(a, sign=-1):
    h, w = a.shape
    return np.array([[sum(a[y, x] * cmath.exp(sign * 2j * math.pi * (u * x / w + v * y / h)) for y in range(h) for x in range(w)) for u in range(w)] for v in range(h)])


def put(spark, given):
    return spark.createDataFrame([(k, y, x, float(a[y, x].real), float(a[y, x].imag)) for k, a in given.items() for y in range(a.shape[0]) for x in range(a.shape[1]) if a[y, x]], "field_id long, line long, at int, re double, im double")


def matrix(df, height, width, by="at"):
    found = {}
    for r in transforms.values(df).collect():
        a = found.setdefault(r["field_id"], np.full((height, width), np.nan, complex))
        a[(r["at"], r["line"]) if by == "at" else (r["line"], r["at"])] = r["re"] + 1j * r["im"]
    return found


@pytest.mark.parametrize(("height", "width", "cells"), [(5, 7, 1 << 18), (5, 7, 10), (7, 1, 4), (1, 6, 4), (8, 12, 30)])
def test_fields_of_any_size(spark, monkeypatch, height, width, cells):
    monkeypatch.setattr(transforms, "CELLS", cells)
    rng = np.random.default_rng(3)
    given = {k: rng.normal(size=(height, width)) + 1j * rng.normal(size=(height, width)) for k in (4, 9, None)}
    given[4][height // 2 :][: height > 1] = 0
    there = transforms.transform(transforms.lines(put(spark, given)), width, height)
    found = matrix(there, height, width)
    assert set(found) == set(given)
    for k in given:
        np.testing.assert_allclose(found[k], direct(given[k]), atol=1e-9)
    back = matrix(transforms.transform(there, height, width, inverse=True), height, width, by="line")
    for k in given:
        np.testing.assert_allclose(back[k], given[k], atol=1e-12)


def test_a_frame_of_real_size_in_many_groups(spark):
    rng = np.random.default_rng(5)
    a = np.zeros((1024, 2048))
    a[rng.integers(0, 1024, 400), rng.integers(0, 1272, 400)] = 1 + rng.random(400)
    there = transforms.transform(transforms.lines(put(spark, {1: a})), 2048, 1024)
    want = np.fft.fft2(a)
    rows = there.collect()
    assert sorted(r["line"] for r in rows) == list(range(2048))
    for r in rows:
        np.testing.assert_allclose(np.array(r["re"]) + 1j * np.array(r["im"]), want[:, r["line"]], atol=1e-8)


def test_repeated_null_outside_and_no_places(spark):
    given = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 0, 2.0), (1, None, 0, 5.0), (1, 0, None, 5.0), (1, 1, 2, None)], "field_id long, line long, at int, re double")
    found = matrix(transforms.transform(transforms.lines(given), 3, 2), 2, 3)
    np.testing.assert_allclose(found[1], np.full((2, 3), 3))
    assert transforms.transform(transforms.lines(given.limit(0)), 3, 2).collect() == []
    for wrong in ((1, 0, 3, 1.0), (1, 2, 0, 1.0), (1, 0, -1, 1.0)):
        with pytest.raises(Exception, match="lies outside"):
            transforms.transform(transforms.lines(spark.createDataFrame([wrong], given.schema)), 3, 2).collect()
    with pytest.raises(ValueError, match="places"):
        transforms.transform(transforms.lines(given), 0, 2)


@pytest.mark.parametrize(("n", "longest"), [(1, 8), (2, 8), (12, 8), (35, 8), (17, 32), (23, 8), (31, 8)])
def test_signals_of_any_length(spark, n, longest):
    rng = np.random.default_rng(n)
    given = {k: rng.normal(size=n) + 1j * rng.normal(size=n) for k in (0, 7)}
    df = spark.createDataFrame([(k, i, float(v.real), float(v.imag)) for k, a in given.items() for i, v in enumerate(a)], "field_id long, i long, re double, im double")
    for inverse, want in ((False, np.fft.fft), (True, np.fft.ifft)):
        rows = transforms.signal_transform(df, n, inverse, longest).collect()
        assert len(rows) == 2 * n
        for k in given:
            found = {r["k"]: r["re"] + 1j * r["im"] for r in rows if r["field_id"] == k}
            np.testing.assert_allclose([found[i] for i in range(n)], want(given[k]), atol=1e-9)


def test_too_long_signals_are_refused(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "field_id long, i long, re double")
    for n, longest in ((0, 8), ((1 << 31) + 1, 8), (97, 8)):
        with pytest.raises(ValueError, match="signal"):
            transforms.signal_transform(df, n, longest=longest)


def test_targets_on_a_grid(spark):
    images = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 1, 8), (2, 0, 1, 3), (3, 0, 0, 0)], "image_id long, py int, px int, level long")
    found = fields.target_grid(images, (2, 2), (8, 8), 8.0, (4.0, 3.0), (1.0, 1.0)).collect()
    assert {r["image_id"] for r in found} == {1, 2} and len(found) == 24
    level = {1: {(0, 0): 0.5, (1, 1): 1.0}, 2: {(0, 1): 1.0}}
    for r in found:
        fx, fy = (min(1, max(0, (r[c] - b + 0.5) / n * 2 - 0.5)) for c, b, n in (("sx", 3, 4), ("sy", 2, 3)))
        want = sum(level[r["image_id"]].get((j, i), 0) * (fx if i else 1 - fx) * (fy if j else 1 - fy) for i in (0, 1) for j in (0, 1))
        assert r["value"] == pytest.approx(want, abs=1e-12) and r["amplitude"] == pytest.approx(math.sqrt(want), abs=1e-6)
        assert (r["y"], r["x"]) == ((r["sy"] + 4) % 8, (r["sx"] + 4) % 8)
    with pytest.raises(ValueError, match="beyond"):
        fields.target_grid(images, (2, 2), (8, 8), 8.0, (4.0, 3.0), (3.0, 0.0))
    assert images.where(F.lit(False)).transform(lambda d: fields.target_grid(d, (2, 2), (8, 8), 8.0, (4.0, 3.0))).collect() == []


@pytest.mark.parametrize("turned", (False, True))
def test_correlation_in_one_task_is_that_by_blocks(spark, monkeypatch, turned):
    rows = [(f, (7 * i * i) % 6, (5 * i) % 10, float(i % 4 + 1), float(turned * (i % 3))) for f in (1, 2, None) for i in range(9)]
    given = transforms.lines(spark.createDataFrame(rows, "field_id long, line long, at int, re double, im double"))

    def found(least=None):
        lags = transforms.correlation(given, 16, 8, least)
        return {(r.field_id, r.line, r["at"][k] if r["at"] is not None else k): round(r.re[k], 6) for r in lags.collect() for k in range(len(r.re))}

    whole, some = found(), found(0.5)
    assert some == {k: v for k, v in whole.items() if v >= 0.5} and 0 < len(some) < len(whole)
    plan = transforms.correlation(given, 16, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1, "the full spectrum must not cross the network"
    monkeypatch.setattr(transforms, "WHOLE", 0)
    assert found() == whole and found(0.5) == some
