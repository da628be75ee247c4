"""All queries over the test tables and the SQL text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: the function becomes query ``name``; ``sql`` is its equivalent."""

    def wrap(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return wrap


def _load() -> None:
    from hybridkb.plans import page_queries, search_queries, store_queries, text_queries, vector_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
