"""What a frame takes over from the accepted frame before it: phases and weights, for tables and streams.

Frames: (sequence_id, trap_id, frame, place, accepted, phase, gain), where `place` is the number of accepted
frames of the sequence before. A trap that the last accepted frame showed goes on from there, any other
starts anew; a frame that isn't accepted leaves nothing behind. Rows with a null among the ids, frame, place
or phase are left out, a null `accepted` is false, a null gain is 1; rows of one trap and frame are taken as
copies of each other.

A state is (sequence_id, trap_id, place, target, synthesis, weight): what the accepted frame with so many
before it left for a trap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lumenloom.functions.numeric import lit, wrap_phase

TRAP = ["sequence_id", "trap_id"]
OUT = "sequence_id long, trap_id long, frame long, target double, synthesis double, weight double"


def _given(frames: DataFrame) -> DataFrame:
    whole = frames.where(" AND ".join(f"{c} IS NOT NULL" for c in (*TRAP, "frame", "place", "phase")))
    return whole.withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn("gain", F.coalesce(F.col("gain").cast("double"), lit(1))).withColumn("phase", F.col("phase").cast("double"))


def states(frames: DataFrame, locked: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """The state that each accepted frame leaves for each of its traps.

    Stretches of places without a gap are one chain: its first row gives phase and synthesis, the gains
    multiply along it. A window sees the rows of one trap.
    """
    rows = _given(frames).where("accepted").dropDuplicates([*TRAP, "frame"]).select(*TRAP, "place", "phase", F.lit(None).cast("double").alias("kept"), "gain")
    if initial is not None:
        rows = rows.unionByName(initial.select(*TRAP, "place", F.col("target").alias("phase"), F.col("synthesis").alias("kept"), F.col("weight").alias("gain")))
    chained = rows.withColumn("chain", F.col("place") - F.row_number().over(W.partitionBy(*TRAP).orderBy("place")))
    along = W.partitionBy(*TRAP, "chain").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    start, kept, step = F.first("phase").over(along), F.first(F.coalesce("kept", "phase")).over(along), F.count("*").over(along)
    told = chained.select(*TRAP, "place", "phase", start.alias("start"), kept.alias("kept"), step.alias("step"), F.product("gain").over(along).alias("weight"))
    target = F.col("start") if locked else F.col("phase")
    synthesis = F.when(F.col("step") == 1, F.col("kept")).otherwise(wrap_phase(F.col("kept") + target - F.col("start")))
    return told.select(*TRAP, "place", target.alias("target"), synthesis.alias("synthesis"), "weight")


def carried(frames: DataFrame, locked: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """What each frame begins with for each trap: sequence_id, trap_id, frame, target, synthesis, weight.

    With `locked` a trap keeps the target phase that it had, else the frame's own counts. `initial` are
    states to go on from.
    """
    before = states(frames, locked, initial).select(*TRAP, (F.col("place") + 1).alias("place"), F.col("target").alias("was"), F.col("synthesis").alias("kept"), F.col("weight").alias("weighed"))
    rows = _given(frames).dropDuplicates([*TRAP, "frame"]).join(before, [*TRAP, "place"], "left")
    target = F.coalesce("was", "phase") if locked else F.col("phase")
    synthesis = F.when(F.col("kept").isNull(), target).otherwise(wrap_phase(F.col("kept") + wrap_phase(target - F.col("was"))))
    return rows.select(*TRAP, "frame", target.alias("target"), synthesis.alias("synthesis"), F.coalesce("weighed", lit(1)).alias("weight"))


def _wrapped(angle: float) -> float:
    m = angle + math.pi
    m -= 2 * math.pi * math.floor(m / (2 * math.pi))
    return math.pi if m <= 0 else m - math.pi


class _Carry(StatefulProcessor):
    """One trap of one sequence. Rows wait until the watermark has passed their time, then go in the order
    of frames; a frame at or before the last one told is a replay."""

    def __init__(self, locked: bool):
        self.locked = locked

    def init(self, handle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "place long, target double, synthesis double, weight double")
        self.told = handle.getValueState("told", "frame long")
        self.waiting = handle.getMapState("waiting", "frame long", "time long, place long, accepted boolean, phase double, gain double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.left.update((int(r.place), float(r.target), float(r.synthesis), float(r.weight)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = self.told.get()[0] if self.told.exists() else None
        due = set()
        for batch in rows:
            for r in batch.itertuples(index=False):
                if told is not None and r.frame <= told or self.waiting.containsKey((int(r.frame),)):
                    continue
                self.waiting.updateValue((int(r.frame),), (int(r.at_ms), int(r.place), bool(r.accepted), float(r.phase), float(r.gain)))
                due.add(int(r.at_ms))
        for at in due:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((frame[0], *value) for frame, value in self.waiting.iterator() if value[0] <= until)
        state, out = self.left.get() if self.left.exists() else None, []
        for frame, _, place, accepted, phase, gain in ready:
            self.waiting.removeKey((frame,))
            before = state if state is not None and state[0] == place - 1 else None
            target = before[1] if before and self.locked else phase
            synthesis = _wrapped(before[2] + _wrapped(target - before[1])) if before else target
            weight = before[3] if before else 1.0
            out.append((key[0], key[1], frame, target, synthesis, weight))
            if accepted:
                state = (place, target, synthesis, weight * gain)
        if out:
            self.told.update((out[-1][2],))
            if state is not None:
                self.left.update(state)
            yield pd.DataFrame(out, columns=["sequence_id", "trap_id", "frame", "target", "synthesis", "weight"])

    def close(self) -> None:
        pass


def carried_stream(frames: DataFrame, time: str = "ts", late: str = "1 hour", locked: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """`carried` over a stream with a column of event time that grows with the frames.

    A row is told once the watermark has passed its time, so rows of one trap may come in any order within
    `late`. The state of a trap is one tuple and its waiting rows, so a sequence spreads over all tasks.
    Needs a state store that holds several variables a key, such as RocksDB's.
    """
    rows = _given(frames).where(F.col(time).isNotNull()).withWatermark(time, late)
    # the event-time column must reach the operator for late rows to be known
    asked = rows.select(*[F.col(c).cast("long").alias(c) for c in (*TRAP, "frame", "place")], "accepted", "phase", "gain", F.unix_millis(time).alias("at_ms"), time)
    begin = None if initial is None else initial.select(*TRAP, "place", "target", "synthesis", "weight").groupBy(*TRAP)
    return asked.groupBy(*TRAP).transformWithStateInPandas(_Carry(locked), OUT, "Append", "EventTime", initialState=begin)
