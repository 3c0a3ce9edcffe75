"""Where queries and their DuckDB twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL twin if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r6_share(a: Column, b: Column) -> Column:
    """a / b of whole numbers (b > 0, below 10^8) rounded to 6 places: what ``r6`` of it gives, without decimals for each row."""
    return F.call_function("div", a * 2_000_000 + b, b * 2) / 1e6
