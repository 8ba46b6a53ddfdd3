"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.catalog.sql import with_shared

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql may name the shared subqueries."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = with_shared(sql)
        return build

    return register


def r(column: Column | str, digits: int = 6) -> Column:
    """Round half away from zero in binary arithmetic, as the check engine does; keeps the name."""
    x = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    rounded = F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale
    return rounded.alias(column) if isinstance(column, str) else rounded


def single(column: str) -> Column:
    """Single precision, for averages that may fall between two decimals; keeps the name."""
    return F.col(column).cast("float").cast("double").alias(column)


def n(column: str) -> Column:
    """Whole number as BIGINT; keeps the column's name."""
    return F.col(column).cast("long").alias(column)
