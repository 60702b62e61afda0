"""Queries that validate the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import quality as Q
from newsloom.plans.base import articles, behaviors, blank_sql, history, split_sql
from newsloom.runtime import Scratch

REQUIRED = {
    "articles": ["article_id", "title", "subtitle", "ner_clusters", "entity_groups", "published_time", "category", "category_str"],
    "behaviors": ["impression_id", "user_id", "impression_time", "article_id", "article_ids_clicked", "article_ids_inview"],
    "history": ["user_id", "impression_time_fixed", "article_id_fixed", "scroll_percentage_fixed", "read_time_fixed"],
}
LISTS = [("articles", "ner_clusters"), ("articles", "image_ids"), ("behaviors", "article_ids_inview"), ("behaviors", "article_ids_clicked"), ("history", "article_id_fixed"), ("history", "impression_time_fixed")]
QUALITY_TABLES = {"articles": articles, "behaviors": behaviors, "history": history}
KEYS = {"articles": "article_id", "behaviors": "impression_id", "history": "user_id"}


def _per_table(make) -> DataFrame:
    out = None
    for t in QUALITY_TABLES:
        one = make(t).select(F.lit(t).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def schema_null_profile(spark: SparkSession, d: str) -> DataFrame:
    """Null count and ratio of every column that the files have."""
    return _per_table(lambda t: Q.null_profile(QUALITY_TABLES[t](spark, d)))


def table_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the files, with their type and place."""
    return _per_table(lambda t: spark.createDataFrame([(n, i, k) for i, (n, k) in enumerate(Q.schema_of(QUALITY_TABLES[t](spark, d)), 1)], "column_name string, place int, type_name string"))


def file_validation(spark: SparkSession, d: str) -> DataFrame:
    """Per table: rows, missing required columns, status; a table that can't be read to its end fails with a message."""
    rows = []
    for name, required in REQUIRED.items():
        try:
            df = QUALITY_TABLES[name](spark, d)
            missing = Q.required_columns(df, required)
            # every required column that is there is read: a broken part of the file shows up here, not later
            n = df.agg(F.count("*").alias("n"), *[F.count(c) for c in required if c not in missing]).first()["n"]
            rows.append((name, n, ",".join(missing), "FAIL" if missing else "PASS"))
        except Exception as e:  # noqa: BLE001 - whatever keeps a table from being read is its report
            rows.append((name, None, getattr(e, "getCondition", lambda: None)() or type(e).__name__, "FAIL"))
    return spark.createDataFrame(rows, "table_name string, row_count bigint, missing_columns string, status string")


def list_length_summary(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, c in LISTS:
        one = QUALITY_TABLES[table](spark, d).agg(*Q.numeric_summary(F.size(c))).select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def article_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Rows, columns and keys of the three tables."""
    return _per_table(lambda t: Q.catalogue(QUALITY_TABLES[t](spark, d), KEYS[t]))


def article_validation(spark: SparkSession, d: str) -> DataFrame:
    return Q.article_validation(articles(spark, d))


def history_validation(spark: SparkSession, d: str) -> DataFrame:
    return Q.history_validation(history(spark, d))


def history_profile(spark: SparkSession, d: str) -> DataFrame:
    return Q.history_profile(history(spark, d))


def click_length_distribution(spark: SparkSession, d: str) -> DataFrame:
    return Q.click_lengths(behaviors(spark, d))


def behavior_profile(spark: SparkSession, d: str) -> DataFrame:
    return Q.behavior_profile(behaviors(spark, d))


def adjacent_time_disorder(spark: SparkSession, d: str) -> DataFrame:
    return Q.time_disorder(behaviors(spark, d), Scratch(spark, "disorder"))


def unsorted_history_users(spark: SparkSession, d: str) -> DataFrame:
    return Q.unsorted_users(history(spark, d))


def inview_length_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many impressions show each number of articles."""
    return behaviors(spark, d).groupBy(F.coalesce(F.size("article_ids_inview"), F.lit(0)).cast("bigint").alias("n")).agg(F.count("*").alias("n_rows"))


def users_without_history(spark: SparkSession, d: str) -> DataFrame:
    """Users of each split without a history row."""
    out = None
    for s in ("train", "validation"):
        one = Q.users_without_history(behaviors(spark, d, s), history(spark, d)).select(F.lit(s).alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def behavior_validation(spark: SparkSession, d: str) -> DataFrame:
    return Q.behavior_validation(behaviors(spark, d, "train"), "train").unionByName(Q.behavior_validation(behaviors(spark, d, "validation"), "validation"))


def cross_reference_report(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for s in ("train", "validation"):
        one = Q.missing_references(Q.references(behaviors(spark, d, s), history(spark, d)), articles(spark, d)).select(F.lit(s).alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def missing_id_audit(spark: SparkSession, d: str) -> DataFrame:
    """Distinct referenced ids without an article, with where they are referred to."""
    refs = Q.references(behaviors(spark, d), history(spark, d)).select("kind", "article_id").distinct()
    known = articles(spark, d).where("article_id is not null").select(F.col("article_id").cast("bigint"))
    return refs.join(known, "article_id", "left_anti").select(F.col("kind").alias("source"), "article_id")


def user_overlap(spark: SparkSession, d: str) -> DataFrame:
    h, out = history(spark, d), None
    for s in ("train", "validation", None):
        one = Q.user_overlap(h, behaviors(spark, d, s)).select(F.lit(s or "combined").alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def current_article_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Articles being read in train and in validation."""
    t = behaviors(spark, d, "train").where("article_id is not null").select("article_id").distinct()
    v = behaviors(spark, d, "validation").where("article_id is not null").select("article_id").distinct()
    both = t.withColumn("t", F.lit(1)).join(v.withColumn("v", F.lit(1)), "article_id", "full_outer")
    return both.agg(F.count("t").alias("train_ids"), F.count("v").alias("validation_ids"), F.count_if(F.col("t").isNotNull() & F.col("v").isNotNull()).alias("both_ids"))


def overall_status(spark: SparkSession, d: str) -> DataFrame:
    """Worst status of the article, history and behaviour checks."""
    a = article_validation(spark, d).select(F.lit("articles").alias("part"), "status")
    h = history_validation(spark, d).select(F.lit("history").alias("part"), Q.status(F.col("null_user_rows") + F.col("dup_user_rows") > 0, F.col("null_element_rows") + F.col("reorder_rows") > 0).alias("status"))
    b = behavior_validation(spark, d).agg(Q.status(F.sum("usable_rows") == 0, F.sum("excluded_rows") > 0).alias("status")).select(F.lit("behaviors").alias("part"), "status")
    parts = a.unionByName(h).unionByName(b)
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARNING", 1).otherwise(0)
    total = parts.agg(F.max(rank).alias("r")).select(F.lit("overall").alias("part"), F.when(F.col("r") == 2, "FAIL").when(F.col("r") == 1, "WARNING").otherwise("PASS").alias("status"))
    return parts.unionByName(total)


_names = (
    "schema_null_profile table_schemas file_validation list_length_summary article_catalogue article_validation history_validation history_profile click_length_distribution "
    "behavior_profile adjacent_time_disorder unsorted_history_users inview_length_summary users_without_history behavior_validation cross_reference_report missing_id_audit user_overlap current_article_overlap overall_status"
).split()
QUERIES = {n: globals()[n] for n in _names}

_ARTICLE_VALIDATION = f"""
select *, case when null_id_rows > 0 or duplicate_id_rows > 0 then 'FAIL'
  when blank_text_rows + null_category_rows + blank_category_rows + null_time_rows + list_mismatch_rows > 0 then 'WARNING' else 'PASS' end status
from (select count(*) row_count, count(*) filter (article_id is null) null_id_rows,
  count(*) filter ({blank_sql('title')} and {blank_sql('subtitle')}) blank_text_rows,
  count(*) filter (category is null) null_category_rows, count(*) filter ({blank_sql('category_str')}) blank_category_rows,
  count(*) filter (published_time is null) null_time_rows,
  count(*) filter (coalesce(len(ner_clusters), 0) <> coalesce(len(entity_groups), 0)) list_mismatch_rows,
  (select cast(coalesce(sum(n), 0) as bigint) from (select count(*) n from articles where article_id is not null group by article_id having count(*) > 1)) duplicate_id_rows
  from articles)
"""
_PAIRS = "list_filter(list_zip(article_id_fixed, impression_time_fixed), lambda p: p[1] is not null and p[2] is not null)"
_falls = lambda x, op: f"len(list_filter(range(1, len({x})), lambda i: ({x})[i + 1] {op} ({x})[i]))"
_HISTORY_VALIDATION = f"""
with f as (select user_id is null null_user, user_id is not null and count(*) over (partition by user_id) > 1 dup_user,
    article_id_fixed is null or impression_time_fixed is null null_list,
    coalesce(len(article_id_fixed) <> len(impression_time_fixed), false) mismatch,
    coalesce(len(list_filter(article_id_fixed, lambda x: x is null)) > 0, false) null_element,
    coalesce({_falls(f"list_transform({_PAIRS}, lambda p: p[2])", '<')}, 0) > 0 falls from history)
select count(*) row_count, count(*) filter (null_user) null_user_rows, count(*) filter (dup_user) dup_user_rows, count(*) filter (null_list) null_list_rows,
  count(*) filter (mismatch) mismatch_rows, count(*) filter (null_element) null_element_rows,
  count(*) filter (null_user or dup_user or null_list or mismatch) excluded_rows, count(*) filter (not (null_user or dup_user or null_list or mismatch)) usable_rows,
  count(*) filter (not (null_user or dup_user or null_list or mismatch) and falls) reorder_rows from f
"""
_uniq = lambda c: f"list_distinct(list_filter(coalesce({c}, []), lambda x: x is not null))"
_uniqn = lambda c: f"(len(list_distinct(coalesce({c}, []))) + (case when len(list_filter(coalesce({c}, []), lambda x: x is null)) > 0 then 1 else 0 end))"


def usable_sql(split: str) -> str:
    """Behaviour rows of a split with their exclusion flags."""
    v = split == "validation"
    c, i = _uniq("article_ids_clicked"), _uniq("article_ids_inview")
    return f"""(select *, not (bad_impression or bad_user or bad_time or bad_click or bad_inview or bad_member) usable from (
      select *, impression_id is null or count(*) over (partition by impression_id) > 1 bad_impression, user_id is null bad_user, impression_time is null bad_time,
        len({c}) = 0 bad_click, {f"len({i}) = 0" if v else "false"} bad_inview,
        {f"len({c}) > 0 and len({i}) > 0 and len(list_filter({c}, lambda x: not list_contains({i}, x))) > 0" if v else "false"} bad_member
      from {split_sql(split)}))"""


_BEHAVIOR_VALIDATION = " union all ".join(
    f"""select '{s}' split, count(*) row_count, {", ".join(f"count(*) filter (bad_{x}) bad_{x}_rows" for x in ("impression", "user", "time", "click", "inview", "member"))},
  count(*) filter (usable) usable_rows, count(*) filter (not usable) excluded_rows,
  count(*) filter (usable and len({_uniq("article_ids_clicked")}) = 1) usable_single_click_rows, count(*) filter (usable and len({_uniq("article_ids_clicked")}) > 1) usable_multi_click_rows,
  count(*) filter (article_id is null) null_current_rows, {", ".join(f"count(*) filter (article_ids_{c} is null) null_{c}_rows, count(*) filter (len(article_ids_{c}) = 0) empty_{c}_rows, count(*) filter (len(list_filter(article_ids_{c}, lambda x: x is null)) > 0) null_element_{c}_rows, count(*) filter (len({_uniq(f'article_ids_{c}')}) < len(list_filter(article_ids_{c}, lambda x: x is not null))) repeated_{c}_rows" for c in ("clicked", "inview"))},
  count(*) filter (impression_id is null) null_impression_rows from {usable_sql(s)}"""
    for s in ("train", "validation")
)


def references_sql(b: str) -> str:
    return f"""(select * from (select 'history' kind, user_id row_key, cast(unnest(article_id_fixed) as bigint) article_id from history
      union all select 'current', impression_id, article_id from {b} union all select 'clicked', impression_id, unnest(article_ids_clicked) from {b}
      union all select 'inview', impression_id, unnest(article_ids_inview) from {b}) where article_id is not null)"""


def _overlap_sql(split: str | None) -> str:
    b = split_sql(split) if split else "behaviors"
    return f"""select '{split or 'combined'}' split, count(h) history_users, count(b) behavior_users, count(*) filter (h = 1 and b = 1) both_sides,
      count(*) filter (b is null) history_only, count(*) filter (h is null) behavior_only
      from (select user_id, max(h) h, max(b) b from (select user_id, 1 h, null b from history union all select user_id, null, 1 from {b}) where user_id is not null group by 1)"""


_quant = ", ".join(f"round(quantile_cont(n, {q}), 6) p{int(q * 100):02d}" for q in Q.QUANTILES)
SQL = {
    "schema_null_profile": " union all ".join(
        f"""select '{t}' table_name, column_name, cast(n - filled as bigint) null_count, case when n = 0 then 0.0 else round((n - filled) / n, 6) end null_ratio
  from (unpivot (select count(columns(*)) from {t}) on columns(*) into name column_name value filled), (select count(*) n from {t})""" for t in KEYS
    ),
    "table_schemas": " union all ".join(
        f"""select '{t}' table_name, column_name, cast(row_number() over () as int) place, replace(replace(replace(replace(replace(replace(replace(replace(
  case when column_type like '%[]' then 'array<' || left(column_type, length(column_type) - 2) || '>' else column_type end, 'INTEGER', 'int'), 'VARCHAR', 'string'), 'TIMESTAMP', 'timestamp_ntz'), 'BIGINT', 'bigint'), 'SMALLINT', 'smallint'), 'TINYINT', 'tinyint'), 'FLOAT', 'float'), 'BOOLEAN', 'boolean') type_name from (describe {t})""" for t in KEYS
    ),
    "file_validation": " union all ".join(f"select '{t}' table_name, count(*) row_count, '' missing_columns, 'PASS' status from {t}" for t in REQUIRED),
    "list_length_summary": " union all ".join(
        f"select '{t}' table_name, '{c}' column_name, cast(min(n) as double) min, round(avg(n), 6) mean, round(median(n), 6) median, cast(max(n) as double) max, {_quant} from (select len({c}) n from {t})" for t, c in LISTS
    ),
    "article_catalogue": " union all ".join(
        f"select '{t}' table_name, count(*) row_count, (select count(*) from (describe {t})) column_count, count(*) filter ({k} is null) null_ids, count({k}) - count(distinct {k}) duplicate_excess, count(distinct {k}) unique_ids from {t}" for t, k in KEYS.items()
    ),
    "unsorted_history_users": f"""with u as (select distinct user_id from history where user_id is not null and {_falls("list_filter(impression_time_fixed, lambda x: x is not null)", '<')} > 0)
select count(*) users_falling, array_to_string(list_sort(list(user_id))[1:20], ',') examples from u""",
    "inview_length_summary": "select coalesce(len(article_ids_inview), 0) n, count(*) n_rows from behaviors group by 1",
    "users_without_history": " union all ".join(
        f"select '{s}' split, count(*) n_rows, count(distinct user_id) n_users, array_to_string(list_sort(list_distinct(list(user_id)))[1:10], ',') examples from {split_sql(s)} where user_id is not null and user_id not in (select user_id from history where user_id is not null)" for s in ("train", "validation")
    ),
    "article_validation": _ARTICLE_VALIDATION,
    "history_validation": _HISTORY_VALIDATION,
    "history_profile": f"""
with k as (select *, list_filter(impression_time_fixed, lambda x: x is not null) t, list_filter(article_id_fixed, lambda x: x is not null) a from history)
select count(*) row_count, count(*) filter (impression_time_fixed is null) null_impression_time_fixed, count(*) filter (article_id_fixed is null) null_article_id_fixed,
  count(*) filter (scroll_percentage_fixed is null) null_scroll_percentage_fixed, count(*) filter (read_time_fixed is null) null_read_time_fixed,
  count(*) filter (len(article_id_fixed) = 0) empty_rows, count(*) filter (len(article_id_fixed) <> len(impression_time_fixed)) length_mismatch_rows,
  count(*) filter ({_falls('t', '<')} > 0) falling_time_rows, count(*) filter ({_falls('t', '=')} > 0) equal_time_rows,
  cast(sum(coalesce(len(article_id_fixed) - len(a), 0)) as bigint) null_ids, cast(sum(coalesce(len(a) - len(list_distinct(a)), 0)) as bigint) repeat_visits,
  cast(sum(coalesce({_falls('a', '=')}, 0)) as bigint) consecutive_repeats from k
""",
    "click_length_distribution": f"""select 'raw' kind, coalesce(len(article_ids_clicked), 0) n, count(*) n_rows from behaviors group by 2
union all select 'unique', {_uniqn('article_ids_clicked')}, count(*) from behaviors group by 2""",
    "behavior_profile": f"""
select count(*) row_count, {", ".join(f"count(*) filter ({c} is null) null_{c}" for c in ("impression_id", "user_id", "impression_time", "article_id", "article_ids_clicked", "article_ids_inview"))},
  count(impression_id) - count(distinct impression_id) duplicate_excess, count(*) filter (coalesce(len(article_ids_clicked), 0) <> u) rows_with_repeated_clicks,
  count(*) filter (u = 0) no_click_rows, count(*) filter (u = 1) single_click_rows, count(*) filter (u > 1) multi_click_rows
from (select *, {_uniqn('article_ids_clicked')} u from behaviors)
""",
    "adjacent_time_disorder": """
with k as (select distinct user_id, impression_id, impression_time from behaviors where user_id is not null and impression_id is not null and impression_time is not null),
s as (select user_id, impression_time < lag(impression_time) over w falls, impression_time = lag(impression_time) over w same from k window w as (partition by user_id order by impression_id)),
p as (select user_id, count(*) filter (falls) falls, count(*) filter (same) same from s group by 1)
select count(*) users, count(*) filter (falls > 0) users_falling, cast(sum(falls) as bigint) falling_pairs, cast(sum(same) as bigint) equal_pairs from p
""",
    "behavior_validation": _BEHAVIOR_VALIDATION,
    "cross_reference_report": " union all ".join(
        f"""select '{s}' split, kind, count(*) n_references, count(distinct article_id) n_ids,
  array_to_string(list_sort(list_distinct(list(article_id)))[1:10], ',') examples, count(distinct row_key) n_rows
  from {references_sql(split_sql(s))} where article_id not in (select article_id from articles where article_id is not null) group by kind"""
        for s in ("train", "validation")
    ),
    "missing_id_audit": f"select distinct kind source, article_id from {references_sql('behaviors')} where article_id not in (select article_id from articles where article_id is not null)",
    "user_overlap": " union all ".join(_overlap_sql(s) for s in ("train", "validation", None)),
    "current_article_overlap": f"""with t as (select distinct article_id from {split_sql('train')} where article_id is not null), v as (select distinct article_id from {split_sql('validation')} where article_id is not null)
select (select count(*) from t) train_ids, (select count(*) from v) validation_ids, (select count(*) from t join v using (article_id)) both_ids""",
    "overall_status": f"""
with p as (select 'articles' part, status from ({_ARTICLE_VALIDATION})
  union all select 'history', case when null_user_rows + dup_user_rows > 0 then 'FAIL' when null_element_rows + reorder_rows > 0 then 'WARNING' else 'PASS' end from ({_HISTORY_VALIDATION})
  union all select 'behaviors', case when sum(usable_rows) = 0 then 'FAIL' when sum(excluded_rows) > 0 then 'WARNING' else 'PASS' end from ({_BEHAVIOR_VALIDATION}))
select part, status from p union all
select 'overall', case max(case status when 'FAIL' then 2 when 'WARNING' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'WARNING' else 'PASS' end from p
""",
}
