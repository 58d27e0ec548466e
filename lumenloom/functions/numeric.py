"""Scalar expressions shared by all operators."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value: float) -> Column:
    return F.lit(float(value))


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def half_up(v: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(v * lit(scale) + lit(0.5)) / lit(scale)


def wrap_phase(v: Column) -> Column:
    """The equivalent angle in (-pi, pi]."""
    wrapped = F.pmod(v + lit(math.pi), lit(2 * math.pi)) - lit(math.pi)
    return F.when(wrapped <= lit(-math.pi), lit(math.pi)).otherwise(wrapped)


def angular_distance(a: Column, b: Column) -> Column:
    return F.abs(wrap_phase(a - b))


def smoothstep5(t: Column) -> Column:
    t = clamp(t, lit(0), lit(1))
    return t * t * t * (lit(10) + t * (lit(-15) + lit(6) * t))


def round_up(v: Column, period: Column) -> Column:
    """The next multiple of a period; 0 for what is not positive."""
    return F.when(v <= 0, lit(0)).otherwise(F.ceil(v / period - lit(1e-12)) * period)


def power_of_two_at_least(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(lit(2), F.ceil(F.log2(n)))).cast("long")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def safe_ratio(a: Column, b: Column, default: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b)).otherwise(default)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often it stands there: lambdas evaluate what they name
    anew for every element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))
