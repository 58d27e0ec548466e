"""Proof that paths keep clear of each other at all times, whatever the times of their waypoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit
from lumenloom.operators.conflicts import boxed

#: Numbers closer than this are the same.
NEAR = 1e-9
#: A part that lasts longer than so many cells of time meets others by place alone.
LONG = 64
PART = ("trajectory", "start", "stop", "x", "y", "x_end", "y_end", "sigma", "speed")


def parts(ways: DataFrame, top: float) -> DataFrame:
    """The stretches of each path from time 0 to top: from waypoint to waypoint, at rest before the first
    and after the last; speed: the highest on the stretch, so 0 at rest. Waypoints without a place or a
    time count as not given; a stretch that takes no time is left out."""
    given = ways.where("x is not null and y is not null and arrival is not null")
    order = W.partitionBy("trajectory").orderBy("seq")
    follow = given.select("trajectory", "x", "y", F.coalesce("sigma", lit(0)).alias("sigma"), F.col("arrival").cast("double").alias("start"), F.lag("seq").over(order).isNull().alias("first"), F.lead("arrival").over(order).cast("double").alias("stop"), *[F.lead(c).over(order).alias(f"{c}_end") for c in "xy"])
    here = F.struct("start", F.coalesce("stop", lit(top)).alias("stop"), F.coalesce("x_end", "x").alias("x_end"), F.coalesce("y_end", "y").alias("y_end"))
    before = F.when(F.col("first"), F.struct(lit(0).alias("start"), F.col("start").alias("stop"), F.col("x").alias("x_end"), F.col("y").alias("y_end")))
    both = follow.select("trajectory", "x", "y", "sigma", F.explode(F.array(here, before)).alias("p"))
    speed = lit(1.875) * F.hypot(F.col("x_end") - F.col("x"), F.col("y_end") - F.col("y")) / (F.col("stop") - F.col("start"))
    return both.select("trajectory", "p.start", "p.stop", "x", "y", "p.x_end", "p.y_end", "sigma").where("start < stop").withColumn("speed", speed)


def _together(cells: DataFrame, lasting: DataFrame) -> DataFrame:
    """Pairs of parts that share a cell of the plane and some time, each pair once."""

    def side(df: DataFrame, name: str, *keys: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{name}_{c}") for c in (*PART, "lx", "ly")], *[F.col(c).alias(f"{name}_{c}") for c in ("lt",) if c in df.columns], *keys)

    keys = ("ct", "cx", "cy")
    at_once = side(cells, "a", *keys).join(side(cells, "b", *keys), [*keys]).where((F.col("a_trajectory") < F.col("b_trajectory")) & (F.col("ct") == F.greatest("a_lt", "b_lt"))).drop("ct", "a_lt", "b_lt")
    # Cells of time would repeat a part that meets a lasting one, so here it stands once for each place.
    short = cells.where("ct = lt").drop("ct", "lt")
    mixed = side(short, "a", *keys[1:]).join(side(lasting, "b", *keys[1:]), [*keys[1:]]).where("a_trajectory != b_trajectory")
    resting = side(lasting, "a", *keys[1:]).join(side(lasting, "b", *keys[1:]), [*keys[1:]]).where("a_trajectory < b_trajectory")
    lowest = (F.col("cx") == F.greatest("a_lx", "b_lx")) & (F.col("cy") == F.greatest("a_ly", "b_ly"))
    pairs = at_once.unionByName(mixed).unionByName(resting).where(lowest)
    return pairs.where(F.greatest("a_start", "b_start") < F.least("a_stop", "b_stop"))


def _prove(depth: int):
    def place(f: dict, side: str, row: np.ndarray, t: np.ndarray) -> np.ndarray:
        u = (t - f[f"{side}_start"][row]) / (f[f"{side}_stop"][row] - f[f"{side}_start"][row])
        q = u**3 * (10 + u * (-15 + 6 * u))
        return np.stack([f[f"{side}_{c}"][row] + (f[f"{side}_{c}_end"][row] - f[f"{side}_{c}"][row]) * q for c in "xy"])

    def prove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            f = {c: frame[c].to_numpy(float) for c in frame.columns if c[2:] != "trajectory"}
            n, safe, speed = len(frame), f["safe"], f["a_speed"] + f["b_speed"]
            failed = np.full(n, np.inf)
            row, lo, hi = np.arange(n), f["start"].copy(), f["stop"].copy()
            seen = []
            for level in range(depth + 1):
                if not len(row):
                    break
                middle = lo + (hi - lo) / 2
                gap = [np.hypot(*(place(f, "a", row, t) - place(f, "b", row, t))) for t in (lo, middle, hi)]
                least = np.minimum.reduce(gap)
                seen.append((row, lo, least))
                close = least < safe[row] - NEAR
                open_ = ~close & (hi - lo > NEAR) & (gap[1] <= safe[row] + speed[row] * (hi - lo) / 2 + NEAR)
                bad = close | open_ if level == depth else close
                np.minimum.at(failed, row[bad], lo[bad])
                go = open_ & (lo < failed[row])
                row, lo, hi, middle = row[go], lo[go], hi[go], middle[go]
                row, lo, hi = np.concatenate((row, row)), np.concatenate((lo, middle)), np.concatenate((middle, hi))
            # What a search from left to right has met by the time it fails.
            met = np.full(n, np.inf)
            for row, lo, least in seen:
                on = lo <= failed[row]
                np.minimum.at(met, row[on], least[on])
            out = pd.DataFrame({"a_id": frame["a_trajectory"], "b_id": frame["b_trajectory"], "start": f["start"], "stop": f["stop"], "least": met, "safe": safe})
            yield out[np.isfinite(failed)]

    return prove


def unproven(ways: DataFrame, *, minimum: float, margin: float, sigmas: float, depth: int = 12) -> DataFrame:
    """(a_id, b_id, start, stop, least, safe): pairs of paths not proven clear, with the first interval
    that isn't; all other pairs of the plane are proven.

    ways: trajectory, seq, x, y, arrival, sigma. Paths move with minimum jerk between waypoints, stand
    at the first before its time and at the last to the end of all. Between neighbouring waypoints of
    either path both move on one stretch each, so the overlaps in time of their stretches are the
    intervals between the breakpoints of both. An interval is proven if in its middle the distance
    exceeds safe = minimum + margin + sigmas * (both sigma) and what both can move in half of it (at the
    highest speeds of the two stretches; those of whole paths would hold up paths at rest), or if its
    halves are; it fails where a distance falls below safe, or after `depth` halvings. least:
    the smallest distance met from the left up to where it fails.

    A stretch stands in the cells of time and place that its swept box touches, widened by half of the
    largest safe and by what the last halving leaves open, so that no pair beyond can fail; lasting
    stretches stand in cells of place. No pair farther apart than neighbouring cells is formed. An
    empty table and a single path give no rows.
    """
    spans = ways.groupBy("trajectory").agg((F.max("arrival") - F.min("arrival")).alias("span"), (F.count("arrival") - 1).alias("legs"), F.max("arrival").alias("top"), F.max("sigma").alias("sigma"))
    facts = spans.agg(F.max("top").alias("top"), F.max("sigma").alias("sigma"), (F.sum("span") / F.nullif(F.sum("legs"), F.lit(0))).alias("mean")).first()
    widest = minimum + margin + 2 * sigmas * float(facts["sigma"] or 0.0)
    size, tick = max(4 * widest, NEAR), max(float(facts["mean"] or 0.0), NEAR)
    stretches = parts(ways, max(0.0, float(facts["top"] or 0.0)))
    around = lit(widest / 2 + NEAR) + F.col("speed") * (F.col("stop") - F.col("start")) * lit(0.5 ** (depth + 1))
    wide = boxed(stretches, around, size)
    lasting = F.col("stop") - F.col("start") > lit(LONG * tick)
    first, last = (F.floor(F.col(c) / lit(tick)).cast("long") for c in ("start", "stop"))
    cells = wide.where(~lasting).withColumn("lt", first).withColumn("ct", F.explode(F.sequence(first, last)))
    pairs = _together(cells, wide.where(lasting))
    safe = lit(minimum + margin) + lit(sigmas) * (F.col("a_sigma") + F.col("b_sigma"))
    columns = [f"{s}_{c}" for s in "ab" for c in PART if c != "sigma"]
    asked = pairs.select(*columns, F.greatest("a_start", "b_start").alias("start"), F.least("a_stop", "b_stop").alias("stop"), safe.alias("safe"))
    found = asked.mapInPandas(_prove(depth), "a_id long, b_id long, start double, stop double, least double, safe double")
    # A lasting part may be either side of a pair.
    low, high = F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")
    return found.groupBy(low, high).agg(F.min(F.struct("start", "stop", "least", "safe")).alias("f")).select("a_id", "b_id", "f.*")
