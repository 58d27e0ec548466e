"""Order-dependent work along paths, many at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions import geometry
from lumenloom.functions.numeric import lit


def _on_segments(x: np.ndarray, y: np.ndarray, key: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, x, y) of the samples of many paths, rows sorted by key and order.

    A sample lies `spacing` of travelled way behind the one before it, so on one segment samples stand
    at the carried distance and every spacing after it: floor((length - carried) / spacing) + 1 of them.
    As each is rounded to six digits and the way goes on from there, the rounding is carried as a
    correction of the distance that is left: the segments with the same number of their path go
    together, and among them the samples with the same number.
    """
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    number = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    out = [(key[begin], np.zeros(len(begin), np.int64), np.round(x[begin], 6), np.round(y[begin], 6))]
    carried = np.full(len(begin), spacing)
    count = np.zeros(len(begin), np.int64)
    path = np.cumsum(first) - 1
    for n in range(1, int(number.max(initial=0)) + 1):
        end = np.flatnonzero(number == n)
        at = np.stack([x[end - 1], y[end - 1]], axis=1)
        to = np.stack([x[end], y[end]], axis=1)
        length = np.hypot(*(to - at).T)
        on = np.arange(len(end))
        # Only paths with a sample left on this segment go on; all of them take one each time.
        while len(on := on[(length[on] > 0) & (length[on] - carried[path[end[on]]] >= -np.finfo(float).eps)]):
            p = path[end[on]]
            at[on] = np.round(at[on] + (to[on] - at[on]) * (carried[p] / length[on])[:, None], 6)
            count[p] += 1
            out.append((key[end[on]], count[p].copy(), at[on, 0].copy(), at[on, 1].copy()))
            length[on] = np.hypot(*(to[on] - at[on]).T)
            carried[p] = spacing
        rest = carried[path[end]] - length
        carried[path[end]] = np.where(rest > spacing * 1e-12, rest, spacing)
    return tuple(np.concatenate(c) for c in zip(*out))


def resampled(waypoints: DataFrame, key: str, spacing: float) -> DataFrame:
    """(key, n, x, y): points at equal travelled distance along each path, the first one included, rounded
    to six digits. Paths are dealt out by their key and walked side by side in batches of whole paths."""

    def walk(frames):
        held = None
        for frame in frames:
            held = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
            done = held[key] != held[key].iloc[-1] if len(held) else pd.Series([], dtype=bool)
            if done.any():
                yield sampled(held[done])
                held = held[~done].reset_index(drop=True)
        if held is not None and len(held):
            yield sampled(held)

    def sampled(rows: pd.DataFrame) -> pd.DataFrame:
        found = _on_segments(rows["x"].to_numpy(float), rows["y"].to_numpy(float), rows[key].to_numpy(), spacing)
        return pd.DataFrame(dict(zip((key, "n", "x", "y"), found)))

    ways = waypoints.select(key, "seq", "x", "y").repartition(key).sortWithinPartitions(key, "seq")
    return ways.select(key, "x", "y").mapInPandas(walk, f"{key} long, n int, x double, y double")


def detours(moves: DataFrame, key: str, around: DataFrame, separation: float, margin: float) -> DataFrame:
    """Places to go by when the straight way of a move is taken: (key, k, ox, oy, length, place).

    moves: (key, x, y, tx, ty); around: (x, y) of whatever stands there and of parking places. Four corners
    and four middles of the sides of the box about all of it and the move, wider by four separations and the
    margin, and the two places beside the middle of the way. `place` counts from the shortest way on, lengths
    to six digits, equal ones by k. Without anything around, the box is about the move.
    """
    wide = lit(4 * separation + margin)
    box = around.agg(F.min("x").alias("w0"), F.max("x").alias("w1"), F.min("y").alias("v0"), F.max("y").alias("v1"))
    b = moves.crossJoin(F.broadcast(box)).withColumns({"x0": F.least("w0", "x", "tx") - wide, "x1": F.greatest("w1", "x", "tx") + wide, "y0": F.least("v0", "y", "ty") - wide, "y1": F.greatest("v1", "y", "ty") + wide})
    half = lambda p, q: (F.col(p) + F.col(q)) / 2
    sides, along, beside = [(x, y) for x in ("x0", "x1") for y in ("y0", "y1")], half("x", "tx"), lit(2 * separation)
    spots = [(F.col(x), F.col(y)) for x, y in sides] + [(half("x0", "x1"), F.col(y)) for y in ("y0", "y1")] + [(F.col(x), half("y0", "y1")) for x in ("x0", "x1")] + [(along, half("y", "ty") + beside), (along, half("y", "ty") - beside)]
    rows = b.select(key, "x", "y", "tx", "ty", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("ox"), y.alias("oy")) for k, (x, y) in enumerate(spots)])).alias("o")).select(key, "x", "y", "tx", "ty", "o.*")
    spot = (F.col("ox"), F.col("oy"))
    way = geometry.distance((F.col("x"), F.col("y")), spot) + geometry.distance(spot, (F.col("tx"), F.col("ty")))
    measured = rows.select(key, "k", "ox", "oy", (F.floor(way * lit(1e6) + lit(0.5)) / lit(1e6)).alias("length"))
    return measured.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("length", "k")))
