"""Normalisation and validation: every check gives rows of (code, id), none stops at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit

def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < lit(float("inf")))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns are added, nulls are filled."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(code, id) of every row and every check that is not met; null counts as not met."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()])
    return df.select(F.explode(F.array_compact(failed)).alias("code"), F.col(key).alias("id"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("DUPLICATE_ID").alias("code"), F.col(key).alias("id"))


def region_shape_ok(kind: Column, coordinates: Column) -> Column:
    """circle: 3 numbers, radius >= 0; box: 4, ordered; polygon: an even number, at least 6."""
    c = lambda i: F.get(coordinates, F.lit(i))
    return (
        F.when(kind == "circle", (F.size(coordinates) == 3) & (c(2) >= 0))
        .when(kind == "box", (F.size(coordinates) == 4) & (c(0) <= c(2)) & (c(1) <= c(3)))
        .when(kind == "polygon", (F.size(coordinates) >= 6) & (F.size(coordinates) % 2 == 0))
        .otherwise(F.lit(False))
    )


def enough(atoms: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: required, available and whether every required target can have an atom."""
    need = targets.agg(F.count_if("required").alias("required"))
    have = atoms.agg(F.count_if("movable").alias("available"))
    return need.crossJoin(have).withColumn("accepted", F.col("available") >= F.col("required"))


def sample_gates(margin: float = 2e-5) -> dict[str, tuple[str, Column]]:
    """name -> (reason, condition) of rows (traps, told, phase, converged, flags), in order."""
    bad = F.array(F.lit("ZERO_TARGET_OUTPUT"), F.lit("NUMERIC_ERROR"))
    return {
        "count_ok": ("TRAP_COUNT", F.size("traps") == F.col("told")),
        "unique_traps": ("DUPLICATE_TRAP", F.size(F.array_distinct("traps")) == F.size("traps")),
        "phase_ok": ("PHASE", F.abs("phase") <= F.pi() + lit(margin)),
        "converged_ok": ("NOT_CONVERGED", F.col("converged")),
        "flags_ok": ("FLAGGED", F.size(F.array_intersect("flags", bad)) == 0),
    }


def first_rejection(gates: dict[str, tuple[str, Column]]) -> Column:
    """The reason of the first gate that is not met, null if all are; null counts as not met."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in gates.values()])


def all_finite(text: Column) -> Column:
    """Whether a JSON text is readable and none of its numbers, at any depth, is NaN or infinite."""
    odd = F.regexp_count(F.regexp_replace(text, r'"([^"\\\\]|\\\\.)*"', '""'), F.lit("NaN|Infinity"))
    return F.coalesce((odd == 0) & F.try_parse_json(text).isNotNull(), F.lit(False))
