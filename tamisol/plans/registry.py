"""The core's queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamisol.plans import catalogue, landed, preparation  # noqa: F401 (landed adds its queries to the catalogue)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**catalogue.QUERIES, **preparation.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.SQL)
