"""Where queries and their SQL are named, and values as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sql_text(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values_sql(columns: str, values: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql_text, v)) + ')' for v in values)}) t({columns})"
