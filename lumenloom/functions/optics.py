"""Optical relations: coordinates, resolution, mode overlap, code tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.numeric import clamp, let, lit


def field_of_view(wavelength: Column, focal: Column, pitch: Column) -> Column:
    return wavelength * focal / pitch


def first_null(wavelength: Column, focal: Column, aperture: Column, pitch: Column) -> Column:
    return wavelength * focal / (aperture * pitch)


def wrapped_index(v: Column, extent: Column) -> Column:
    return F.pmod(v, extent)


def periodic_distance(a: Column, b: Column, extent: Column) -> Column:
    d = F.abs(F.pmod(a, extent) - F.pmod(b, extent))
    return F.least(d, extent - d)


def principal_frequency(k: Column, n: Column) -> Column:
    """The equivalent of k in [-n/2, n/2)."""
    return F.pmod(k + n / 2, n) - n / 2


def gaussian_amplitude(r2: Column, diameter: Column) -> Column:
    return F.exp(lit(-4) * r2 / (diameter * diameter))


def dirichlet(d: Column, active: Column, n: Column) -> Column:
    below = active * F.sin(lit(math.pi) * d / n)
    return F.when(F.abs(below) < lit(1e-12), lit(1)).otherwise(F.abs(F.try_divide(F.sin(lit(math.pi) * active * d / n), below)))


def gaussian_overlap(r2: Column) -> Column:
    return F.exp(lit(-0.5) * r2)


def table_decode(code: Column, table: Column) -> Column:
    """Linear interpolation in an array whose entries belong to codes 0..255."""
    at = clamp(code, lit(0), lit(255)) / lit(255) * (F.size(table) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.size(table) - 1)
    return F.get(table, low) + (F.get(table, high) - F.get(table, low)) * (at - low)


def quantize(phase: Column, codes: int = 256) -> Column:
    """Code of a wrapped phase: halves go up, ends are clamped."""
    share = (phase + lit(math.pi)) / lit(2 * math.pi)
    return clamp(F.floor(share * lit(codes - 1) + lit(0.5)), lit(0), lit(codes - 1)).cast("int")


def dequantize(code: Column, codes: int = 256) -> Column:
    return code / lit(codes - 1) * lit(2 * math.pi) - lit(math.pi)


def turned_frequency(p: tuple[Column, Column], origin: tuple[Column, Column], scale: Column, angle: float) -> tuple[Column, Column]:
    """A place in the plane as frequency of a grid that is scaled and turned; the grid's y points down."""
    x, y, c, s = p[0] * scale, p[1] * scale, lit(math.cos(angle)), lit(math.sin(angle))
    return origin[0] + c * x - s * y, origin[1] - s * x - c * y


def nearest_entry(v: Column, entries: Column) -> Column:
    """Index of the array entry nearest to v, the lowest of equal ones."""
    apart = F.transform(entries, lambda e, i: F.struct(F.abs(e - v).alias("d"), i.alias("i")))
    return F.array_min(apart)["i"]


def nearest_spans(entries: Column, at: Callable[[Column], Column], size: int) -> Column:
    """Which of the values at(0) .. at(size - 1), rising and evenly apart, have which array entry nearest (the
    lowest index of equal ones), without looking at all of them: structs (index, first, last) of the entries
    that have any. Between neighbouring entries the border is estimated and its four places compared."""
    sorted_ = F.array_sort(F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))))
    step = (at(F.lit(size - 1)) - at(F.lit(0))) / (size - 1)

    def below(a: Column, b: Column) -> Column:
        """How many values are nearer to a than to the next higher b."""
        estimate = F.floor(((a["e"] + b["e"]) / 2 - at(F.lit(0))) / step).cast("long") - 1
        first = lambda k: F.when(a["i"] < b["i"], F.abs(a["e"] - at(k)) <= F.abs(b["e"] - at(k))).otherwise(F.abs(a["e"] - at(k)) < F.abs(b["e"] - at(k)))
        return let(estimate, lambda near: F.greatest(F.lit(0).cast("long"), F.least(F.lit(size).cast("long"), near + sum((first(near + k).cast("long") for k in range(4)), F.lit(0)))))

    def spans(v: Column) -> Column:
        begin = F.transform(v, lambda e, k: F.when(k == 0, F.lit(0).cast("long")).otherwise(let(F.get(v, F.greatest(k - 1, F.lit(0))), lambda a: below(a, e))))
        ends = lambda first: F.transform(v, lambda e, k: F.struct(e["i"].alias("index"), F.get(first, k).alias("first"), (F.coalesce(F.get(first, k + 1), F.lit(size).cast("long")) - 1).alias("last")))
        return F.filter(let(begin, ends), lambda e: e["first"] <= e["last"])

    # Of equal entries the lowest index has all.
    single = lambda v: F.filter(v, lambda e, k: (k == 0) | (e["e"] != F.get(v, F.greatest(k - 1, F.lit(0)))["e"]))
    return let(let(sorted_, single), spans)


def phase_tolerance(tolerance: Column, codes: int) -> Column:
    """The phase error that a number of codes allows: a step and a half, at least 0.001."""
    return F.greatest(tolerance, lit(1e-3), lit(3 * math.pi / codes))
