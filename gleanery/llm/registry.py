"""The queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from gleanery.llm import (  # noqa: F401
        bpe, chat, chunks, dedup, fingerprint, lm, mixing, negatives, periods, quality, secrets, sharding, toxicity)
