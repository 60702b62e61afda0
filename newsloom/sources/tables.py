"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.runtime import sound


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; columns and filters are pruned by the optimiser."""
    return sound(spark).read.parquet(f"{folder}/{name}.parquet")
