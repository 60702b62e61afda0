"""All queries of this subpackage with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import abuse_queries, group_queries, linkname_queries, packing_queries, plainform_queries, run_queries, setjoin_queries, token_queries

MODULES = (plainform_queries, linkname_queries, setjoin_queries, run_queries, group_queries, token_queries, packing_queries, abuse_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
