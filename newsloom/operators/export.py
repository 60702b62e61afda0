"""Packages of tables with checks and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_key_defects(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_if(F.col(key).isNull()).alias("null_keys"), (F.count(key) - F.count_distinct(key)).alias("repeated_keys"))


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys that the parent doesn't have; must be empty before an export."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").select(key)


def export_package(tables: dict[str, DataFrame], folder: str, keys: dict[str, str] | None = None) -> DataFrame:
    """Writes each table as zstd Parquet under ``folder`` (replacing what was there) and a manifest beside them.

    A table with a key named in ``keys`` is refused if a key is null or repeated.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        if keys and name in keys:
            bad = unique_key_defects(df, keys[name]).first()
            if bad["null_keys"] or bad["repeated_keys"]:
                raise ValueError(f"{name}.{keys[name]} has {bad['null_keys']} null and {bad['repeated_keys']} repeated values")
        path = f"{folder}/{name}.parquet"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()  # noqa: SLF001
        rows.append((name, path, spark.read.parquet(path).count(), len(df.columns), size))
    manifest = spark.createDataFrame(rows, "table_name string, path string, n_rows bigint, n_columns int, n_bytes bigint")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest.json")
    return manifest
