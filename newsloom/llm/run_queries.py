"""Queries of problem 4: reading runs of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.runs import collapse_runs
from newsloom.runtime import Scratch
from newsloom.sources import load


def _micros(column: str) -> F.Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))


def reading_events(spark: SparkSession, d: str) -> DataFrame:
    """Reading events of both sequences in the form ``collapse_runs`` takes."""
    shown = (
        load(spark, d, "behaviors")
        .where("user_id is not null and impression_time is not null and article_id is not null and impression_id is not null")
        .select(F.lit("behaviors").alias("seq"), F.col("user_id").alias("entity"), _micros("impression_time").alias("ts"), F.col("impression_id").alias("key"), F.col("article_id").cast("bigint").alias("item"))
    )
    read = (
        load(spark, d, "history")
        .where("user_id is not null and size(article_id_fixed) = size(impression_time_fixed)")
        .select("user_id", F.posexplode(F.arrays_zip("article_id_fixed", "impression_time_fixed")).alias("key", "e"))
        .select("user_id", "key", F.col("e.article_id_fixed").alias("article_id"), F.col("e.impression_time_fixed").alias("t"))
        .where("article_id is not null and t is not null")
        .select(F.lit("history").alias("seq"), F.col("user_id").alias("entity"), _micros("t").alias("ts"), F.col("key").cast("bigint"), F.col("article_id").cast("bigint").alias("item"))
    )
    return shown.unionByName(read)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least two readings of one article, neighbours at most 30 minutes apart."""
    return collapse_runs(reading_events(spark, d), Scratch(spark, "runs")).select(
        F.col("seq").alias("seq_name"), F.col("entity").alias("user_id"), "first_key", "last_key", F.col("item").alias("article_id"), "n_events", "span_secs"
    )


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
with e as (
  select distinct 'behaviors' seq_name, user_id, impression_time t, impression_id k, article_id from behaviors
  where user_id is not null and impression_time is not null and article_id is not null and impression_id is not null
  union all
  select distinct 'history', user_id, impression_time_fixed[i + 1], i, article_id_fixed[i + 1]
  from (select user_id, article_id_fixed, impression_time_fixed, unnest(range(len(article_id_fixed))) i from history
        where user_id is not null and len(article_id_fixed) = len(impression_time_fixed))
  where article_id_fixed[i + 1] is not null and impression_time_fixed[i + 1] is not null
),
m as (
  select *, case when lag(article_id) over w = article_id and t - lag(t) over w <= interval 30 minutes then 0 else 1 end head
  from e window w as (partition by seq_name, user_id order by t, k)
),
g as (select *, sum(head) over (partition by seq_name, user_id order by t, k) run from m)
select seq_name, cast(user_id as bigint) user_id, cast(arg_min(k, (t, k)) as bigint) first_key, cast(arg_max(k, (t, k)) as bigint) last_key,
  cast(min(article_id) as bigint) article_id, count(*) n_events, cast(floor(epoch(max(t) - min(t))) as bigint) span_secs
from g group by seq_name, user_id, run having count(*) >= 2
""",
}
