"""Named queries with their checking SQL. Each `plans` module adds its own when imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliograph.plans.prelude import with_tables
from foliograph.sources.fixtures import Library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register `fn(library) -> DataFrame`; `sql` may use the prelude tables named in `tables`."""
    def add(fn: Callable[[Library], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, root: fn(Library(spark, root))
        if sql is not None:
            ORACLES[name] = with_tables(sql, *tables)
        return fn
    return add
