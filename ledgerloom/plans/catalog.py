"""Registry of runnable queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import Tables, tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (), extra: dict[str, str] | None = None):
    """Register a function of the input tables, with the SQL that must return the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes, extra=extra)
        return fn

    return register


from . import queries_pages, queries_rows, queries_canonical, queries_coa, queries_views, queries_state  # noqa: E402,F401
