"""Registry of the library's own queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans import code_queries, constraint_queries, report_queries, source_queries  # noqa: F401 - each adds its queries
from weftgraph.plans.queries import SQL, Q

FLAGSHIP = "refine_full"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
