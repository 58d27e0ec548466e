"""Minimum-jerk motion: position, derivatives, duration bounds and intensity ramps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.numeric import clamp, lit, round_up, smoothstep5


def progress(t: Column) -> Column:
    return t * t * t * (lit(10) + t * (lit(-15) + lit(6) * t))


def speed(t: Column) -> Column:
    t = clamp(t, lit(0), lit(1))
    return lit(30) * t * t * (t - 1) * (t - 1)


def acceleration(t: Column) -> Column:
    t = clamp(t, lit(0), lit(1))
    return lit(60) * t - lit(180) * t * t + lit(120) * t * t * t


def jerk(t: Column) -> Column:
    t = clamp(t, lit(0), lit(1))
    return lit(60) - lit(360) * t + lit(360) * t * t


def largest_step(length: Column, frames: Column) -> Column:
    """The largest part of a segment that a frame takes."""
    step = lambda i: progress((i + 1) / frames) - progress(i / frames)
    return length * F.array_max(F.transform(F.sequence(F.lit(0), frames - 1), step))


#: Peaks of the unit minimum-jerk profile for speed, acceleration and jerk.
PEAK_SPEED, PEAK_ACCELERATION, PEAK_JERK = 1.875, 5.774, 60.0


def segment_duration(length: Column, v: Column, a: Column, j: Column, period: Column) -> Column:
    """Least duration that keeps the limits, rounded up to whole periods."""
    needed = F.greatest(lit(PEAK_SPEED) * length / v, F.sqrt(lit(PEAK_ACCELERATION) * length / a), F.cbrt(lit(PEAK_JERK) * length / j), period)
    return round_up(needed, period)


def ramp_duration(change: Column, most: Column, period: Column, minimum: Column) -> Column:
    """Whole periods that a smooth change of intensity needs when a frame may change it by `most`."""
    return F.greatest(period, round_up(minimum, period), F.ceil(lit(PEAK_SPEED) * F.abs(change) / most) * period)


def intensity(t: Column, begin: Column, end: Column, initial: Column, moving: Column, final: Column, rise: Column, settle: Column, release: Column | None = None) -> Column:
    """Initial level, smooth rise before the motion, moving level, smooth settling behind it to the final
    level; with a `release` above 0, that level then fades in so long a time."""
    up = initial + (moving - initial) * smoothstep5((t - (begin - rise)) / rise)
    down = moving + (final - moving) * F.when(settle > 0, smoothstep5((t - end) / settle)).otherwise(lit(1))
    if release is not None:
        down = down * (lit(1) - F.when(release > 0, smoothstep5((t - (end + settle)) / release)).otherwise(lit(0)))
    return F.when(t < begin - rise, initial).when(t < begin, up).when(t <= end, moving).otherwise(down)
