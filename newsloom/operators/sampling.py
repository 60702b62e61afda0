"""Samples that are the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.ranking import grouped_row_number
from newsloom.runtime import Scratch


def diverse_sample(df: DataFrame, stratum: str, entity: str, order: list, k: int, per_entity: int, scratch: Scratch) -> DataFrame:
    """Per stratum, ``k`` rows spread evenly over the order, at most ``per_entity`` of an entity.

    Rows are visited at the evenly spaced places of min(n, 8k) first, then in
    order; each entity keeps its first visited rows and the sample its first k.
    Places round half to even.  A sampling operator: its limit is the feature.
    Places are numbered over range partitions; the two ranks under a limit keep
    their first rows in each task before anything is shuffled.
    """
    at = scratch.keep(grouped_row_number(df, [stratum], order, "__nth", scratch))
    sizes = at.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    placed = at.join(sizes, F.col(stratum).eqNullSafe(F.col("__s"))).withColumn("__at", F.col("__nth") - 1)
    m = F.least(F.col("__n"), F.lit(8 * k))
    step = F.when(m > 1, (F.col("__n") - 1) / (m - 1)).otherwise(F.lit(1.0))
    near = F.bround(F.col("__at") / step)
    spread = F.when(m >= F.col("__n"), F.lit(True)).when(m == 1, F.col("__at") == F.floor(F.col("__n") / 2)).otherwise((near < m) & (F.bround(near * step) == F.col("__at")))
    visit = [F.when(spread, 0).otherwise(1).alias("v"), F.col("__at").alias("a")]
    visited = placed.withColumn("__visit", F.struct(*visit))
    kept = visited.withColumn("__e", F.row_number().over(Window.partitionBy(stratum, entity).orderBy("__visit"))).where(F.col("__e") <= per_entity)
    ranked = kept.withColumn("sample_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("__visit")).cast("bigint")).where(F.col("sample_rank") <= k)
    return ranked.select(*df.columns, "sample_rank")
