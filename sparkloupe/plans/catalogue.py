"""All registered queries of the library's own operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloupe.plans import findings_queries, more_queries, source_queries, tree_queries
from sparkloupe.plans.findings_queries import flagship

__all__ = ["flagship", "oracle_sql", "queries"]

_MODULES = (findings_queries, source_queries, tree_queries, more_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
