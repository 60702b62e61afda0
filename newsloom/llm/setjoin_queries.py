"""Queries of problem 3: articles close in time that name largely the same entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.names import name_key, unique_articles
from newsloom.llm.run_queries import _micros
from newsloom.llm.setjoin import similar_pairs
from newsloom.runtime import Scratch

SPAN = 72 * 3600 * 1_000_000


def named_sets(spark: SparkSession, d: str) -> DataFrame:
    keys = F.filter(F.transform("ner_clusters", name_key), lambda x: x.isNotNull() & (x != ""))
    return unique_articles(spark, d, "ner_clusters", "published_time").select(F.col("article_id").alias("id"), _micros("published_time").alias("ts"), keys.alias("tokens"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of articles at most 72 hours apart with Jaccard similarity of at least 0.5."""
    pairs = similar_pairs(named_sets(spark, d), Scratch(spark, "setjoin"), threshold=0.5, span_micros=SPAN, min_size=3)
    return pairs.select(F.col("id_a").alias("article_a"), F.col("id_b").alias("article_b"))


QUERIES = {"p3_found": p3_found}

SQL = {
    "p3_found": """
with a as (select article_id, any_value(published_time) t, any_value(ner_clusters) m from articles where article_id is not null group by 1),
k as (select distinct article_id, t, lower(trim(regexp_replace(x, ' +', ' ', 'g'), ' ')) k from (select article_id, t, unnest(m) x from a where t is not null)),
s as (select article_id, t, list(k) ks, count(*) n from k where k is not null and k <> '' group by 1, 2 having count(*) >= 3)
select cast(x.article_id as bigint) article_a, cast(y.article_id as bigint) article_b
from s x join s y on x.article_id < y.article_id and abs(epoch_us(x.t) - epoch_us(y.t)) <= 259200000000
where 3 * len(list_intersect(x.ks, y.ks)) >= x.n + y.n
""",
}
