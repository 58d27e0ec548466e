"""What is wrong with a compiled sequence: assignment, frames, final places, final traps, quality, clearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.geometry import distance
from lumenloom.functions.numeric import lit
from lumenloom.operators import clearances


def _issues(df: DataFrame, level: str | Column, code: str | Column, **found: Column | str) -> DataFrame:
    """level, code and the columns below; what isn't named is null."""
    kinds = {"atom_id": "long", "other_id": "long", "site_id": "long", "frame": "long", "measured": "double"}
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    named = {k: F.col(v) if isinstance(v, str) else v for k, v in found.items()}
    return df.select(text(level).alias("level"), text(code).alias("code"), *[named.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def unassigned(assigned: DataFrame, sites: DataFrame) -> DataFrame:
    """Required sites without an atom, and sites with more than one; measured: the number of atoms."""
    taken = assigned.where("site_id is not null").groupBy("site_id").agg(F.count("*").alias("n"))
    asked = sites.select("site_id", F.coalesce("required", F.lit(False)).alias("required"))
    n = F.coalesce("n", F.lit(0))
    return _issues(asked.join(taken, "site_id", "full").where((n > 1) | (F.col("required") & (n == 0))), "error", "ASSIGNMENT_INFEASIBLE", site_id="site_id", measured=n)


def unmatched_frames(frames: DataFrame, descriptors: DataFrame, metrics: DataFrame) -> DataFrame:
    """Frames that don't stand exactly once in each of the three; measured: the highest number of times."""
    tables = (frames.select("frame").distinct(), descriptors.select("frame"), metrics.select("frame"))
    marked = [t.select("frame", *[F.lit(int(i == k)).alias(f"n{i}") for i in range(3)]) for k, t in enumerate(tables)]
    counts = marked[0].unionByName(marked[1]).unionByName(marked[2]).groupBy("frame").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)])
    n = [F.col(f"n{i}") for i in range(3)]
    return _issues(counts.where((n[0] != 1) | (n[1] != 1) | (n[2] != 1)), "error", "FRAME_COUNT_MISMATCH", frame="frame", measured=F.greatest(*n))


def misplaced(assigned: DataFrame, sites: DataFrame, ways: DataFrame, tolerance: float) -> DataFrame:
    """Atoms whose way ends farther than tolerance from their site; measured: how far."""
    ends = ways.groupBy(F.col("trajectory").alias("atom_id")).agg(F.max_by(F.struct("x", "y"), "seq").alias("end"))
    goals = sites.select("site_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    far = distance((F.col("end.x"), F.col("end.y")), (F.col("tx"), F.col("ty")))
    both = assigned.select("atom_id", "site_id").join(goals, "site_id").join(ends, "atom_id").withColumn("far", far)
    return _issues(both.where(F.col("far") > lit(tolerance)), "error", "FINAL_POSITION_MISMATCH", atom_id="atom_id", site_id="site_id", measured="far")


def released(assigned: DataFrame, sites: DataFrame, ways: DataFrame, frames: DataFrame, intensity: float) -> DataFrame:
    """Atoms with a way and a site that the last frame doesn't hold in their trap at the site's intensity
    (else the given one); measured: the trap's, null without one."""
    traps = ways.select(F.col("trajectory").alias("atom_id"), "trap_id").distinct()
    # One number decides which frame is the last; its traps are found by an equi-join.
    last = frames.agg(F.max("frame").alias("frame"))
    held = frames.join(F.broadcast(last), "frame").select("trap_id", F.col("atom_id").alias("holds"), "intensity")
    goals = sites.select("site_id", F.coalesce("final_intensity", lit(intensity)).alias("wanted"))
    both = assigned.select("atom_id", "site_id").join(goals, "site_id").join(traps, "atom_id").join(held, "trap_id", "left")
    kept = F.col("holds").eqNullSafe(F.col("atom_id")) & (F.col("intensity") > 0) & (F.abs(F.col("intensity") - F.col("wanted")) <= lit(1e-6))
    return _issues(both.where(~F.coalesce(kept, F.lit(False))), "error", "ILLEGAL_LIFECYCLE", atom_id="atom_id", site_id="site_id", measured="intensity")


def rejected_frames(metrics: DataFrame) -> DataFrame:
    """Frames that aren't valid or accepted are errors, those that are but haven't converged warnings."""
    good = F.coalesce(F.col("valid") & F.col("accepted"), F.lit(False))
    level, code = F.when(good, "warning").otherwise("error"), F.when(good, "WGS_NOT_CONVERGED").otherwise("FRAME_QUALITY_REJECTED")
    return _issues(metrics.where(~good | ~F.coalesce("converged", F.lit(False))), level, code, frame="frame")


def issues(assigned: DataFrame, sites: DataFrame, ways: DataFrame, frames: DataFrame, descriptors: DataFrame, metrics: DataFrame, *, minimum: float, margin: float, sigmas: float, depth: int = 12, intensity: float = 1.0) -> DataFrame:
    """level, code, atom_id, other_id (the second of two that come too near), site_id, frame, measured: all
    that is wrong with a sequence; it is accepted if no row is an error.

    assigned: atom_id, site_id (null: none). sites: site_id, x, y, required, final_intensity. ways:
    trajectory (the atom), trap_id, seq, x, y, arrival, sigma. frames: frame, trap_id, atom_id,
    intensity. descriptors: frame. metrics: frame, valid, accepted, converged. A null flag counts as
    false. An assignment to an unknown site, or without a way, has no final place to be judged.
    """
    clear = clearances.unproven(ways, minimum=minimum, margin=margin, sigmas=sigmas, depth=depth)
    parts = (
        unassigned(assigned, sites),
        unmatched_frames(frames, descriptors, metrics),
        misplaced(assigned, sites, ways, max(1e-6, margin * 0.01)),
        released(assigned, sites, ways, frames, intensity),
        rejected_frames(metrics),
        _issues(clear, "error", "COLLISION_VALIDATION_FAILED", atom_id="a_id", other_id="b_id", measured="least"),
    )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
