"""Queries that build the article catalogue and the ids each split uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import blank, strip
from newsloom.operators import catalog as C
from newsloom.plans.base import articles, behaviors, history, strip_sql
from newsloom.plans.quality_queries import usable_sql
from newsloom.runtime import Scratch


def valid(spark: SparkSession, d: str) -> DataFrame:
    return C.valid_articles(articles(spark, d))


def train_ids(spark: SparkSession, d: str) -> DataFrame:
    """Valid articles that train uses."""
    return C.used_ids(behaviors(spark, d, "train"), history(spark, d), False).join(valid(spark, d).select("article_id"), "article_id", "left_semi")


def validation_ids(spark: SparkSession, d: str) -> DataFrame:
    """Valid articles that validation uses, candidates included."""
    return C.used_ids(behaviors(spark, d, "validation"), history(spark, d), True).join(valid(spark, d).select("article_id"), "article_id", "left_semi")


def validation_only_ids(spark: SparkSession, d: str) -> DataFrame:
    return validation_ids(spark, d).join(train_ids(spark, d), "article_id", "left_anti")


def valid_articles(spark: SparkSession, d: str) -> DataFrame:
    return valid(spark, d).select("article_id", "model_text", "published_time")


def article_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Articles left out, by reason; a row with several reasons counts for each."""
    f = C.article_flags(articles(spark, d))
    return f.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(r)).alias(r) for r in C.REASONS])


def train_used_ids(spark: SparkSession, d: str) -> DataFrame:
    return train_ids(spark, d)


def validation_used_ids(spark: SparkSession, d: str) -> DataFrame:
    return validation_ids(spark, d)


def split_id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the id sets of both splits: used, in both, in validation only, referenced but not valid."""
    t = train_ids(spark, d).withColumn("t", F.lit(1))
    v = validation_ids(spark, d).withColumn("v", F.lit(1))
    lost = C.used_ids(behaviors(spark, d, "train"), history(spark, d), False).join(valid(spark, d).select("article_id"), "article_id", "left_anti").agg(F.count("*").alias("train_not_valid"))
    both = t.join(v, "article_id", "full_outer").agg(
        F.count("t").alias("train_used"), F.count("v").alias("validation_used"), F.count_if(F.col("t").isNotNull() & F.col("v").isNotNull()).alias("overlap"), F.count_if(F.col("t").isNull()).alias("validation_only")
    )
    return both.withColumn("train_not_valid", lost.scalar())


def used_id_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Ids that each split uses but that aren't valid articles."""
    out = None
    for split, inview in (("train", False), ("validation", True)):
        one = C.excluded_ids(C.used_ids(behaviors(spark, d, split), history(spark, d), inview), valid(spark, d)).select(F.lit(split).alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def category_mapping(spark: SparkSession, d: str) -> DataFrame:
    used = valid(spark, d).join(train_ids(spark, d), "article_id", "left_semi")
    return C.category_mapping(used)


def categorised(spark: SparkSession, d: str) -> DataFrame:
    return C.with_category(valid(spark, d), category_mapping(spark, d))


def articles_with_category(spark: SparkSession, d: str) -> DataFrame:
    return categorised(spark, d).select("article_id", "category_str", "model_category_id")


def category_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Known, blank and unseen categories of all valid articles."""
    c = categorised(spark, d)
    b = blank(F.col("category_str"))
    unseen = c.where(~b & (F.col("model_category_id") == 0)).select(strip(F.col("category_str")).alias("category_str")).distinct().orderBy("category_str").limit(10)
    return c.agg(F.count("*").alias("n_articles"), F.count_if(F.col("model_category_id") > 0).alias("known"), F.count_if(b).alias("blank"), F.count_if(~b & (F.col("model_category_id") == 0)).alias("unseen")).withColumn(
        "examples", unseen.agg(F.array_join(F.sort_array(F.collect_list("category_str")), "|")).scalar()
    )


def embedding_input(spark: SparkSession, d: str) -> DataFrame:
    return C.embedding_input(valid(spark, d), Scratch(spark, "embedding"))


_names = "valid_articles article_exclusions train_used_ids validation_used_ids split_id_sets used_id_exclusions category_mapping articles_with_category category_coverage embedding_input".split()
QUERIES = {n: globals()[n] for n in _names}

_T, _S = strip_sql("coalesce(title, '')"), strip_sql("coalesce(subtitle, '')")


def _used_sql(split: str, inview: bool) -> str:
    ok = f"(select * from {usable_sql(split)} where not (bad_impression or bad_user or bad_time or bad_click))"
    return f"""(select distinct cast(a as bigint) article_id from (
  select article_id_fixed[i] a, impression_time_fixed[i] t from (select *, unnest(range(1, len(article_id_fixed) + 1)) i
    from (select *, count(*) over (partition by user_id) c from history where user_id is not null) where c = 1 and len(article_id_fixed) = len(impression_time_fixed)) where t is not null
  union all select article_id, null from {ok} union all select unnest(article_ids_clicked), null from {ok}
  {f"union all select unnest(article_ids_inview), null from {ok}" if inview else ""}) where a is not null)"""


#: Shared CTEs: va valid articles, tu / vu ids used by train / validation, vo by validation only, cm categories.
WITH = f"""with recursive va0 as (select *, count(*) over (partition by article_id) copies, {_T} t0, {_S} s0 from articles),
va as (select cast(article_id as bigint) article_id, published_time, ner_clusters, entity_groups, category_str, title, subtitle, body,
  'query: ' || case when t0 <> '' and s0 <> '' then t0 || chr(10) || s0 when t0 <> '' then t0 else s0 end model_text
  from va0 where article_id is not null and copies = 1 and (t0 <> '' or s0 <> '') and published_time is not null and coalesce(len(ner_clusters), 0) = coalesce(len(entity_groups), 0)),
tu as materialized (select article_id from {_used_sql('train', False)} where article_id in (select article_id from va)),
vu as materialized (select article_id from {_used_sql('validation', True)} where article_id in (select article_id from va)),
vo as (select article_id from vu where article_id not in (select article_id from tu)),
cm as (select '<UNK>' category_str, 0 model_category_id union all select c, cast(row_number() over (order by c) as int) from (select distinct {strip_sql('category_str')} c from va where article_id in (select article_id from tu)) where c <> ''),
vc as (select va.*, coalesce(cm.model_category_id, 0) model_category_id from va left join cm on cm.model_category_id > 0 and {strip_sql('va.category_str')} = cm.category_str)
"""
SQL = {
    "valid_articles": WITH + "select article_id, model_text, published_time from va",
    "article_exclusions": WITH + """select count(*) n_rows, count(*) filter (article_id is null) no_id, count(*) filter (article_id is not null and copies > 1) repeated_id,
  count(*) filter (t0 = '' and s0 = '') no_text, count(*) filter (published_time is null) no_time, count(*) filter (coalesce(len(ner_clusters), 0) <> coalesce(len(entity_groups), 0)) list_mismatch from va0""",
    "train_used_ids": WITH + "select * from tu",
    "validation_used_ids": WITH + "select * from vu",
    "split_id_sets": WITH + f"""select (select count(*) from tu) train_used, (select count(*) from vu) validation_used, (select count(*) from tu join vu using (article_id)) overlap, (select count(*) from vo) validation_only,
  (select count(*) from {_used_sql('train', False)} where article_id not in (select article_id from va)) train_not_valid""",
    "category_mapping": WITH + "select * from cm",
    "articles_with_category": WITH + "select article_id, category_str, model_category_id from vc",
    "category_coverage": WITH + f"""select count(*) n_articles, count(*) filter (model_category_id > 0) known, count(*) filter (category_str is null or {strip_sql('category_str')} = '') blank,
  count(*) filter (category_str is not null and {strip_sql('category_str')} <> '' and model_category_id = 0) unseen,
  (select coalesce(array_to_string(list_sort(list(c))[1:10], '|'), '') from (select distinct {strip_sql('category_str')} c from vc where category_str is not null and {strip_sql('category_str')} <> '' and model_category_id = 0)) examples from vc""",
    "used_id_exclusions": WITH + " union all ".join(f"""select '{s}' split, count(*) n_excluded, coalesce(array_to_string(list_sort(list(article_id))[1:10], ','), '') examples, case when count(*) > 0 then 'WARNING' else 'PASS' end status
  from {_used_sql(s, s == 'validation')} where article_id not in (select article_id from va)""" for s in ("train", "validation")),
    "embedding_input": WITH + "select row_number() over (order by article_id) - 1 embedding_row, article_id, model_text from va",
}
