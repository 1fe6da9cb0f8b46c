"""All registered queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .plans.adapters import VIEWS, with_views

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries when imported.
_MODULES = ("findings", "coverage", "scope", "history", "deps", "pages", "text", "source")


def query(sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name; `views` are the adapter views its SQL reads."""

    def register(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(views.split(), sql)
        return f

    return register


def _load() -> None:
    for name in _MODULES:
        import_module(f"qualitylake.plans.{name}_queries")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


__all__ = ["VIEWS", "oracle_sql", "queries", "query"]
