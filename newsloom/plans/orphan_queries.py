"""Queries of problem 6 over the news tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.orphans import Reference, cascade
from newsloom.runtime import Scratch
from newsloom.sources import load

ARTICLE_FIELDS = ("behaviors.article_ids_inview", "behaviors.article_ids_clicked", "history.article_id_fixed")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """One row per article; re-delivered rows agree on the published time."""
    return (
        load(spark, d, "articles")
        .where("article_id is not null")
        .groupBy(F.col("article_id").cast("bigint").alias("parent_key"))
        .agg(F.min("published_time").alias("born"))
    )


def _article_edges(spark: SparkSession, d: str) -> list[Reference]:
    shown = load(spark, d, "behaviors").where("impression_id is not null")
    read = load(spark, d, "history").where("user_id is not null")
    edges = [
        Reference(
            f"behaviors.{c}",
            "behaviors",
            "articles",
            shown.select(F.col("impression_id").alias("ref_key"), F.explode(F.col(c).cast("array<bigint>")).alias("parent_key"), F.col("impression_time").alias("ref_time")),
        )
        for c in ("article_ids_inview", "article_ids_clicked")
    ]
    pairs = read.select(F.col("user_id").alias("ref_key"), F.posexplode(F.col("article_id_fixed").cast("array<bigint>")).alias("i", "parent_key"), F.col("impression_time_fixed").alias("times"))
    edges.append(
        Reference(
            "history.article_id_fixed",
            "history",
            "articles",
            pairs.select("ref_key", "parent_key", F.get("times", F.col("i")).alias("ref_time")),
        )
    )
    return edges


def _graph(spark: SparkSession, d: str) -> tuple[list[Reference], dict[str, DataFrame]]:
    """The whole foreign-key graph of the news tables."""

    def edge(table: str, key: str, field: str, parent: str, time: str | None = None) -> Reference:
        t = load(spark, d, table).where(F.col(key).isNotNull())
        when = F.col(time) if time else F.lit(None).cast("timestamp_ntz")
        return Reference(
            f"{table}.{field}", table, parent, t.select(F.col(key).cast("bigint").alias("ref_key"), F.col(field).cast("bigint").alias("parent_key"), when.alias("ref_time"))
        )

    def keys(table: str, key: str) -> DataFrame:
        return load(spark, d, table).where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("parent_key")).distinct().withColumn("born", F.lit(None).cast("timestamp_ntz"))

    matched = load(spark, d, "article_events").where("article_id is not null")
    edges = [
        *_article_edges(spark, d),
        edge("behaviors", "impression_id", "article_id", "articles", "impression_time"),
        edge("behaviors", "impression_id", "user_id", "history", "impression_time"),
        edge("documents", "doc_id", "article_id", "articles", "created_time"),
        edge("doc_labels", "doc_id", "doc_id", "documents"),
        edge("article_semantic_ids", "article_id", "article_id", "articles"),
        Reference(  # no key of its own: a record is the match of an article and an event
            "article_events.article_id",
            "article_events",
            "articles",
            matched.select(F.xxhash64("article_id", "event_id").alias("ref_key"), F.col("article_id").cast("bigint").alias("parent_key"), F.col("published_time").alias("ref_time")),
        ),
    ]
    return edges, {"articles": _articles(spark, d), "history": keys("history", "user_id"), "documents": keys("documents", "doc_id")}


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges, parents = _graph(spark, d)
    return cascade(edges, parents, Scratch(spark, "orphans"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the orphans of the whole graph, the direct ones of the three article lists, one row per reference."""
    found = _orphans(spark, d).where(F.col("ref_field").isin(*ARTICLE_FIELDS) & (F.col("depth") == 0))
    return found.select("ref_field", "ref_key", F.col("parent_key").alias("article_id"), "orphan_kind", "ref_day")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, kind and day over the whole graph; inherited ones by depth."""
    kind = F.when(F.col("depth") == 0, F.col("orphan_kind")).otherwise(F.format_string("inherited_%d", F.col("depth")))
    return _orphans(spark, d).groupBy(F.col("child").alias("ref_table"), "ref_field", kind.alias("orphan_kind"), "ref_day").agg(F.count("*").alias("n_refs"), F.count_distinct("ref_key").alias("n_records"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

#: The whole graph in SQL: references, direct orphans, then the tainted records by recursion along the foreign keys.
_REPORT = """
with recursive born as (select 'articles' tbl, cast(article_id as bigint) k, min(published_time) born from articles where article_id is not null group by 2
  union all select distinct 'history', user_id, cast(null as timestamp) from history where user_id is not null union all select distinct 'documents', doc_id, null from documents where doc_id is not null),
refs as materialized (select * from (
  select 'behaviors' child, 'behaviors.article_ids_inview' ref_field, cast(impression_id as varchar) rk, cast(impression_id as bigint) ref_key, 'articles' parent, cast(unnest(article_ids_inview) as bigint) parent_key, impression_time t from behaviors where impression_id is not null
  union all select 'behaviors', 'behaviors.article_ids_clicked', cast(impression_id as varchar), impression_id, 'articles', unnest(article_ids_clicked), impression_time from behaviors where impression_id is not null
  union all select 'history', 'history.article_id_fixed', cast(user_id as varchar), user_id, 'articles', article_id_fixed[i], impression_time_fixed[i] from (select *, unnest(range(1, len(article_id_fixed) + 1)) i from history where user_id is not null)
  union all select 'behaviors', 'behaviors.article_id', cast(impression_id as varchar), impression_id, 'articles', article_id, impression_time from behaviors where impression_id is not null
  union all select 'behaviors', 'behaviors.user_id', cast(impression_id as varchar), impression_id, 'history', user_id, impression_time from behaviors where impression_id is not null
  union all select 'documents', 'documents.article_id', cast(doc_id as varchar), doc_id, 'articles', article_id, created_time from documents where doc_id is not null
  union all select 'doc_labels', 'doc_labels.doc_id', cast(doc_id as varchar), doc_id, 'documents', doc_id, null from doc_labels where doc_id is not null
  union all select 'article_semantic_ids', 'article_semantic_ids.article_id', cast(article_id as varchar), article_id, 'articles', article_id, null from article_semantic_ids where article_id is not null
  union all select 'article_events', 'article_events.article_id', article_id || '/' || coalesce(cast(event_id as varchar), ''), null, 'articles', article_id, published_time from article_events where article_id is not null
) where parent_key is not null),
dir as materialized (select distinct child, ref_field, rk, ref_key, parent_key, case when b.k is null then 'absent' else 'later' end kind, coalesce(strftime(t, '%Y-%m-%d'), 'unknown') ref_day
  from refs left join born b on b.tbl = refs.parent and b.k = refs.parent_key where b.k is null or b.born > t),
taint(tbl, k, depth) as (select distinct child, ref_key, 0 from dir where kind = 'absent' and ref_key is not null
  union select r.child, r.ref_key, depth + 1 from taint join refs r on r.parent = tbl and r.parent_key = taint.k where r.ref_key is not null and depth < 20),
tm as (select tbl, k, min(depth) depth from taint group by 1, 2),
inh as (select child, ref_field, rk, coalesce(strftime(t, '%Y-%m-%d'), 'unknown') ref_day, min(depth) + 1 depth from refs join tm on tm.tbl = refs.parent and tm.k = refs.parent_key group by 1, 2, 3, 4)
select child ref_table, ref_field, kind orphan_kind, ref_day, count(*) n_refs, count(distinct rk) n_records from dir group by 1, 2, 3, 4
union all select child, ref_field, 'inherited_' || depth, ref_day, count(*), count(distinct rk) from inh group by 1, 2, 3, 4
"""

SQL = {
    "p6_found": """
with a as (select article_id, min(published_time) born from articles where article_id is not null group by 1),
r as (
  select 'behaviors.article_ids_inview' ref_field, impression_id ref_key, unnest(article_ids_inview) article_id, impression_time t from behaviors where impression_id is not null
  union all
  select 'behaviors.article_ids_clicked', impression_id, unnest(article_ids_clicked), impression_time from behaviors where impression_id is not null
  union all
  select 'history.article_id_fixed', user_id, article_id_fixed[i], impression_time_fixed[i]
  from (select user_id, article_id_fixed, impression_time_fixed, unnest(range(1, len(article_id_fixed) + 1)) i from history where user_id is not null)
)
select distinct r.ref_field, cast(r.ref_key as bigint) ref_key, cast(r.article_id as bigint) article_id,
  case when a.article_id is null then 'absent' else 'later' end orphan_kind,
  coalesce(strftime(r.t, '%Y-%m-%d'), 'unknown') ref_day
from r left join a on a.article_id = r.article_id
where r.article_id is not null and (a.article_id is null or a.born > r.t)
""",
    "p6_report": _REPORT,
}
