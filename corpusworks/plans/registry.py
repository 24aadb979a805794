"""Name → query and name → check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusworks.plans import inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result in DuckDB, on top of the derived views named."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = inputs.with_views(sql, *views) if views else sql
        return fn

    return add
