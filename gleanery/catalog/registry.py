from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Unicode white space at both ends, in the regular expressions of the SQL side.
SQL_SPACE = r"[\t\n\v\f\r\x{85}\p{Z}]"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL for the same rows where SQL can express it."""

    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trimmed(expression: str) -> str:
    """SQL side: trim Unicode white space."""
    return f"regexp_replace({expression}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from gleanery.catalog import (  # noqa: F401
        arrivals, cascade, pages, providers, schedule, staged, store, streams, texts, urls)
