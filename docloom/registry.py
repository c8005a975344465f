"""Collects the queries, and their DuckDB twins, that the library's modules register."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.functions.frames import prepared

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("text", "access", "chunking", "retrieval", "versions", "evaluation", "structure", "documents", "evidence", "streams", "corpus")


def query(name: str, sql: str | None = None):
    """Decorator: registers ``f(spark, sf_dir)`` under ``name``, with the SQL that gives the same rows."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = lambda spark, sf_dir: f(prepared(spark), sf_dir)
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"docloom.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["w2_hybrid_search"](spark, sf_dir)
