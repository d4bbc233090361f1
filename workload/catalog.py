"""Registry of queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(column: str | Column, digits: int, name: str | None = None) -> Column:
    """Rounded output column, so that sums taken in another order compare equal.

    A nudge far below the kept digits decides exact halves the same way in
    every engine.
    """
    c = F.col(column) if isinstance(column, str) else column
    rounded = F.round(c + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)
    alias = name or (column if isinstance(column, str) else None)
    return rounded.alias(alias) if alias else rounded


def r(expr: str, digits: int) -> str:
    """SQL twin of ``rnd``."""
    return f"(round(({expr}) + 1e{-(digits + 3)}, {digits}) + 0.0)"


def stamp(column: str, name: str | None = None) -> Column:
    """UTC text of an instant."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS").alias(name or column)
