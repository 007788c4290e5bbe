"""All queries of the engine by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import files, rules, standins  # noqa: F401 - files and rules add their queries to standins


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(standins.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(standins.SQL)
