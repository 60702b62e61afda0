"""Queries of problem 5: groups of articles chained by events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.groups import consolidate
from newsloom.runtime import Scratch
from newsloom.sources import load


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every article of article_events with the smallest article it is linked to."""
    m = load(spark, d, "article_events").select("article_id", F.when(F.col("event_id") != -1, F.col("event_id")).alias("event_id"))
    return consolidate(m, "article_id", "event_id", Scratch(spark, "groups"))


def p5_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p5_found(spark, d).groupBy("group_id").agg(F.count("*").alias("n_articles"))
    return sizes.groupBy("n_articles").agg(F.count("*").alias("n_groups"))


QUERIES = {"p5_found": p5_found, "p5_sizes": p5_sizes}

_GROUPS = """
with recursive l as (select distinct article_id a, event_id k from article_events where article_id is not null and event_id is not null and event_id <> -1),
e as (select distinct x.a, y.a b from l x join l y using (k) where x.a <> y.a),
r as (select distinct article_id a, article_id g from article_events where article_id is not null
  union select e.b, r.g from r join e on e.a = r.a where r.g < e.b)
"""

SQL = {
    "p5_found": _GROUPS + "select a article_id, min(g) group_id from r group by a",
    "p5_sizes": _GROUPS + ", m as (select a, min(g) g from r group by a) select n n_articles, count(*) n_groups from (select g, count(*) n from m group by g) group by n",
}
