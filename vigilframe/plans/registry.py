"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir); sql continues the views' WITH list, or selects at once."""

    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = SQL + sql
        return fn

    return put
