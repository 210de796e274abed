"""Every registered query of the flow-analytics engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _loaded() -> None:
    from netloom.plans import flow_queries, graph_queries, model_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(SQL)
