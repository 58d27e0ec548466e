"""The catalogue of registered queries and what their definitions share.

Floating results are rounded to six digits by floor(v * 1e6 + 0.5) / 1e6 on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit

FLAGSHIP = "join_01_cheapest_source"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v * lit(1e6) + lit(0.5)) / lit(1e6)


def r9(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v * lit(1e9) + lit(0.5)) / lit(1e9)


def R(v: str) -> str:
    return f"floor(({v}) * 1e6 + 5e-1) / 1e6"


def WRAP(v: str) -> str:
    """wrap_phase in SQL: fmod of a nonnegative amount, then half-open at the low end."""
    m = f"(({v}) + pi() - 2e0 * pi() * floor((({v}) + pi()) / (2e0 * pi())) - pi())"
    return f"CASE WHEN {m} <= -pi() THEN pi() ELSE {m} END"
