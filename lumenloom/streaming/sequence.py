"""Streaming: append by sequence number exactly once, and state carried from frame to frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(samples: DataFrame, key: str = "sample_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Every sample once, however often it is sent within the allowed lateness."""
    return samples.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def carried_phase(frames: DataFrame) -> DataFrame:
    """Per trap the phase change from frame to frame, over micro-batches.

    frames: (trap_id, frame, phase). Of frames at or before the last one seen nothing is sent on, so
    that a replayed batch changes nothing.
    """
    schema = "trap_id long, frame long, change double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_frame, last_phase = state.get if state.exists else (-1, None)
        for batch in batches:
            out = []
            for frame, phase in batch.sort_values("frame")[["frame", "phase"]].itertuples(index=False):
                if frame <= last_frame:
                    continue
                out.append((key[0], frame, None if last_phase is None else phase - last_phase))
                last_frame, last_phase = frame, phase
            if out:
                yield pd.DataFrame(out, columns=["trap_id", "frame", "change"])
        if last_phase is not None:
            state.update((last_frame, last_phase))

    return frames.groupBy("trap_id").applyInPandasWithState(step, schema, "frame long, phase double", "append", GroupStateTimeout.NoTimeout)


def contiguous(ids: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: lowest, highest, number and whether the ids have no gap and no repetition."""
    found = ids.agg(F.min(key).alias("lowest"), F.max(key).alias("highest"), F.count(key).alias("n"), F.countDistinct(key).alias("different"))
    return found.withColumn("complete", (F.col("n") == F.col("different")) & (F.col("highest") - F.col("lowest") + 1 == F.col("n")))
