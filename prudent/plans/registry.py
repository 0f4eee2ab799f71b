"""Registry of named queries over the driver tables and their oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame``.  The oracle text
is an independent DuckDB statement over the same parquet tables; an entry
without oracle text is checked on row counts plus an in-repo unit test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prudent.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


class Tables:
    """Lazy table accessor: ``t.lineitem`` opens the parquet file once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._cache = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = table(self._spark, self._dir, name)
        return self._cache[name]
