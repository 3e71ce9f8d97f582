"""Registration of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketweave.plans import fixtures
from ticketweave.tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``$tickets`` and ``$log_lines`` in the SQL stand for the derived tables."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is already registered")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = fixtures.expand(sql)
        return fn

    return wrap


def _load() -> None:
    from ticketweave.plans import load_all
    load_all()


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, root, fn=fn: fn(Tables(spark, root))) for name, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
