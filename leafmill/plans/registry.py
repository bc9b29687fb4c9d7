"""All registered queries: the core's, and those of the llm subpackage where it is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def core_queries() -> dict[str, Query]:
    from leafmill.plans import queries

    return queries.QUERIES


def core_sql() -> dict[str, str]:
    from leafmill.plans import sql

    return sql.SQL
