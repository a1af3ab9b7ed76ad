"""Query registry: name -> (DataFrame builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a builder under a name, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def core_queries() -> dict[str, Query]:
    from arborlake.plans import catalogue  # noqa: F401  (registers on import)

    return dict(_QUERIES)


def core_sql() -> dict[str, str]:
    core_queries()
    return dict(_SQL)
