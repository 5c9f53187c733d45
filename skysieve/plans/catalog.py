"""Registry of the library's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skysieve.plans import detail_queries, fit_queries, sky_queries, table_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return sky_queries.QUERIES | table_queries.QUERIES | detail_queries.QUERIES | fit_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return sky_queries.SQL | table_queries.SQL | detail_queries.SQL | fit_queries.SQL
