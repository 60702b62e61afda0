"""What problems 1 to 3 read from the article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources import load


def name_key(c: Column) -> Column:
    """A mention in lower case, ordinary spaces trimmed and collapsed, all else as stored."""
    return F.lower(F.trim(F.regexp_replace(c, " +", " ")))


def unique_articles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Articles with a key, re-delivered rows once."""
    return load(spark, d, "articles").where("article_id is not null").select(F.col("article_id").cast("bigint"), *columns).dropDuplicates(["article_id"])
