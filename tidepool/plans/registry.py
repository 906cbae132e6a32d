"""Queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under its function's name; ``views`` are common table expressions that its SQL begins with."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = ", ".join(views)
            ORACLES[f.__name__] = f"WITH {body} {sql}" if body and not sql.lstrip().startswith(",") else f"WITH {body}{sql}" if body else sql
        return f

    return register
