"""The register of queries and their side-by-side checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(check_sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that must agree with it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if check_sql is not None:
            CHECKS[function.__name__] = check_sql
        return function

    return register
