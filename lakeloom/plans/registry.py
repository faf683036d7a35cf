"""All registered queries with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _ORACLE[name] = sql


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def _load() -> None:
    """Imports the modules that register queries, once."""
    from lakeloom.plans import aggregates, engine_queries, relational, scalars, shapes, statement_queries  # noqa: F401
