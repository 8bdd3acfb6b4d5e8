"""All queries of the core, by name, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, indexing, searches, skewed

PARTS = (skewed, audits, searches, indexing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in PARTS for k, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.oracle_sql().items()}
