"""Dense vectors as arrays: norms, normalisation, pooling, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors with mask 1; the number of tokens counts as 1 at least."""
    used = F.filter(F.zip_with(tokens, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    n = F.greatest(F.size(used), F.lit(1))
    total = F.aggregate(used, F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def vector_defects(df: DataFrame, key: str, vector: str, width: int, tolerance: float = 1e-4) -> DataFrame:
    """What keeps vectors from being used: null, wrong width, not finite, not of unit length, repeated or missing rows."""
    v = F.col(vector)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(v.isNull()).alias("null_vectors"),
        F.count_if(F.size(v) != width).alias("wrong_width"),
        F.count_if(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"),
        F.count_if(F.abs(norm(v) - 1) > tolerance).alias("not_unit"),
        (F.count("*") - F.count_distinct(key)).alias("repeated_keys"),
        F.coalesce(F.max(key) + 1 - F.count("*"), F.lit(0)).cast("bigint").alias("row_gaps"),
    )


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group by position, as (group, dim, value)."""
    return df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def require_vectors(df: DataFrame, key: str, vector: str, width: int, n_rows: int | None = None) -> DataFrame:
    """The table itself, if its vectors are single precision and can be used: rows numbered from 0 without a gap, of one width, finite, of unit length."""
    kind = dict(df.dtypes)[vector]
    if kind != "array<float>":
        raise ValueError(f"{vector} is {kind}, not array<float>")
    found = vector_defects(df, key, vector, width).first().asDict()
    n = found.pop("n_rows")
    wrong = {k: v for k, v in found.items() if v}
    if wrong or (n_rows is not None and n != n_rows):
        raise ValueError(f"{n} vectors, {wrong}")
    return df
