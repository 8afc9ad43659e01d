"""Registry of named queries (Spark callables) and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import quote, round_half_up_sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (stable cross-engine comparison); one
    selectExpr so a wide table costs one JVM call."""
    exprs = []
    for f in df.schema.fields:
        q = quote(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(f"{round_half_up_sql(q, digits)} AS {q}")
        else:
            exprs.append(q)
    return df.selectExpr(*exprs)


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of `round_half_up`."""
    f = repr(10.0 ** digits)
    return f"(floor(({expr}) * {f} + 0.5000076293945312) / {f})"


def lit(x: float) -> str:
    """A Python float as an exact DOUBLE literal for the SQL side."""
    return f"CAST({x!r} AS DOUBLE)"


def load_all() -> None:
    from . import (q_analytics, q_drivers, q_features, q_json, q_models, q_readings, q_scoring,  # noqa: F401
                   q_streaming)
