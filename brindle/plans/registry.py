"""Queries by name, each with the SQL that gives the same rows (None where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(q: Query) -> Query:
        QUERIES[q.__name__] = q
        if sql:
            SQL[q.__name__] = sql
        return q

    return add
