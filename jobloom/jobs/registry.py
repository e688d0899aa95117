"""The registered queries over the job tables and the DuckDB SQL that each is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.sources.model import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("search_queries", "fold_queries", "metric_queries", "fairshare_queries", "health_queries", "store_queries", "stream_queries")


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``sql`` continues the common table expressions of the derived tables."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"a query is named {name} already")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = (VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else VIEWS) + sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"jobloom.jobs.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
