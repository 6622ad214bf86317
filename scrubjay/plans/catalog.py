"""Registry of named queries: one per operator id of SURVEY §2.

Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` over the whole
given tables, plus (where one exists) DuckDB SQL computing the same rows
with the same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills the registry
    from scrubjay.plans import (  # noqa: F401
        profile_queries, cleaning_queries, quality_queries, search_queries, linkage_queries, io_queries, stream_queries,
    )


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def per_column_union(view: str, columns: list[str], template: str) -> str:
    """``UNION ALL`` of one SELECT per column; ``template`` uses ``{c}`` (quoted
    column) and ``{name}`` (its name as a literal)."""
    parts = [template.format(c=f'"{c}"', name=f"'{c}'", view=view) for c in columns]
    return " UNION ALL ".join(f"({p})" for p in parts)
