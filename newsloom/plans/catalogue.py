"""All queries of the core, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import catalog_queries, entity_queries, event_queries, linking_queries, misc_queries, orphan_queries, quality_queries, sequence_queries

MODULES = (quality_queries, catalog_queries, entity_queries, event_queries, sequence_queries, linking_queries, misc_queries, orphan_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
