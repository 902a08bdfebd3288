"""All queries over the driver's tables by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import field_queries, ingest_queries, search_queries, table_queries  # noqa: F401  they register their queries
from .registry import FOUND, SQL


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for name, f in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
