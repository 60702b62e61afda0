"""Queries over vectors, exports, JSON columns and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import loose_cast
from newsloom.operators import export as X
from newsloom.operators import vectors as V
from newsloom.operators.ranking import Ordered
from newsloom.plans.base import articles, behaviors, history
from newsloom.runtime import Scratch
from newsloom.sources import load


def embedding_norm_check(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as stored, and made unit vectors, against what an embedding table must hold."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    unit = e.select("vec_id", V.normalised(F.col("embedding")).alias("embedding"))
    return V.vector_defects(e, "vec_id", "embedding", 64).select(F.lit("stored").alias("vectors"), "*").unionByName(V.vector_defects(unit, "vec_id", "embedding", 64).select(F.lit("unit").alias("vectors"), "*"))


def embedding_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each label, by position."""
    return V.centroids(load(spark, d, "embeddings"), "label", "embedding").select("label", F.col("dim").cast("bigint"), F.round("value", 5).alias("value"))


def embedding_nearest_label(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose own label's centroid is the nearest one by cosine."""
    e = load(spark, d, "embeddings").select("vec_id", "label", "embedding")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    # labels are few: their centres travel as one array
    near = e.withColumn("cs", c.agg(F.array_sort(F.collect_list(F.struct("label", "centre")))).scalar())
    near = near.withColumn("best", F.array_max(F.transform("cs", lambda s: F.struct(F.round(V.dot(s["centre"], F.col("embedding")) / V.norm(s["centre"]), 9).alias("cos"), (-s["label"]).alias("l")))))
    return near.groupBy("label").agg(F.count("*").alias("n"), F.count_if(-F.col("best.l") == F.col("label")).alias("nearest_own"))


def export_fk_check(spark: SparkSession, d: str) -> DataFrame:
    """Dangling keys between the tables of an export, per reference."""
    a = articles(spark, d)
    checks = {
        "article_events.article_id": (load(spark, d, "article_events"), "article_id", a, "article_id"),
        "article_semantic_ids.article_id": (load(spark, d, "article_semantic_ids"), "article_id", a, "article_id"),
        "documents.article_id": (load(spark, d, "documents"), "article_id", a, "article_id"),
        "doc_labels.doc_id": (load(spark, d, "doc_labels"), "doc_id", load(spark, d, "documents"), "doc_id"),
        "behaviors.user_id": (behaviors(spark, d), "user_id", history(spark, d), "user_id"),
    }
    out = None
    for name, (child, key, parent, parent_key) in checks.items():
        one = X.dangling(child, key, parent, parent_key).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).select(F.lit(name).alias("reference"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def unique_key_check(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, k in (("articles", "article_id"), ("behaviors", "impression_id"), ("history", "user_id"), ("article_semantic_ids", "article_id"), ("documents", "doc_id")):
        one = X.unique_key_defects(load(spark, d, t), k).select(F.lit(t).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """JSON properties of the event stream by type: how many parse, their sum and range."""
    e = load(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("with_k"), F.sum("p.k").alias("sum_k"), F.min("p.k").alias("min_k"), F.max("p.k").alias("max_k"))


def schema_merge_union(spark: SparkSession, d: str) -> DataFrame:
    """Documents and articles as one list of texts; columns that one side lacks are null."""
    a = articles(spark, d).select(F.lit("article").alias("kind"), F.col("article_id").cast("bigint").alias("id"), F.length("title").alias("title_chars"))
    b = load(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "source", "n_chars")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.count("source").alias("with_source"), F.sum("title_chars").alias("title_chars"), F.sum("n_chars").alias("n_chars"))


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the event stream: a pause of more than 30 minutes starts the next one."""
    e = load(spark, d, "events").where("user_id is not null and ts is not null").select("user_id", "ts", "event_id")
    o = Ordered(e, ["user_id"], ["ts", "event_id"], Scratch(spark, "sessions")).before(["ts"])
    o.rows = o.rows.withColumn("head", F.coalesce((F.col("ts") - F.col("prev_ts") > F.expr("interval 30 minutes")).cast("bigint"), F.lit(1)))
    return o.running("head", "session").rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def loose_casts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the tables read as numbers and times where they can be: values, those that can be read, and their range."""
    e, a = load(spark, d, "events"), articles(spark, d)
    parts = [
        e.select(F.lit("events.event_type").alias("field"), loose_cast(F.col("event_type"), "bigint").alias("n"), F.col("event_type").alias("was")),
        e.select(F.lit("events.props").alias("field"), loose_cast(F.regexp_extract("props", r"(\d+)", 1), "bigint").alias("n"), F.col("props").alias("was")),
        a.select(F.lit("articles.url").alias("field"), loose_cast(F.regexp_extract("url", r"([^/]*)/?$", 1), "bigint").alias("n"), F.col("url").alias("was")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("field").agg(F.count("was").alias("n_values"), F.count("n").alias("n_read"), F.min("n").alias("least"), F.max("n").alias("most"))


_names = "loose_casts embedding_norm_check embedding_centroids embedding_nearest_label export_fk_check unique_key_check json_props schema_merge_union user_sessions".split()
QUERIES = {n: globals()[n] for n in _names}
_FK = lambda name, child, key, parent, pk: f"select '{name}' reference, count(*) n_rows, count(distinct {key}) n_keys from {child} where {key} is not null and {key} not in (select {pk} from {parent} where {pk} is not null)"
SQL = {
    "loose_casts": """select field, count(was) n_values, count(n) n_read, min(n) least, max(n) most from (select 'events.event_type' field, try_cast(event_type as bigint) n, event_type was from events
  union all select 'events.props', try_cast(regexp_extract(props, '(\\d+)', 1) as bigint), props from events union all select 'articles.url', try_cast(regexp_extract(url, '([^/]*)/?$', 1) as bigint), url from articles) group by 1""",
    "embedding_norm_check": """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
n as (select 'stored' vectors, vec_id, v from e union all select 'unit', vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) from e)
select vectors, count(*) n_rows, count(*) filter (v is null) null_vectors, count(*) filter (len(v) <> 64) wrong_width, count(*) filter (len(list_filter(v, lambda x: x is null or not isfinite(x))) > 0) not_finite,
  count(*) filter (abs(sqrt(list_sum(list_transform(v, lambda x: x * x))) - 1) > 1e-4) not_unit, count(*) - count(distinct vec_id) repeated_keys, coalesce(max(vec_id) + 1 - count(*), 0) row_gaps from n group by 1""",
    "embedding_centroids": "select \"label\", dim, round(avg(x), 5) \"value\" from (select \"label\", cast(unnest(embedding) as double) x, unnest(range(len(embedding))) dim from embeddings) group by 1, 2",
    "embedding_nearest_label": """with c as (select "label" cl, list(m order by i) centre from (select "label", i, avg(x) m from (select "label", cast(unnest(embedding) as double) x, unnest(range(len(embedding))) i from embeddings) group by 1, 2) group by 1),
s as (select e.vec_id, e."label", cl, round(list_sum(list_transform(list_zip(centre, embedding), lambda p: p[1] * cast(p[2] as double))) / sqrt(list_sum(list_transform(centre, lambda x: x * x))), 9) cos from embeddings e, c),
b as (select vec_id, "label", arg_max(cl, (cos, -cl)) best from s group by 1, 2)
select "label", count(*) n, count(*) filter (best = "label") nearest_own from b group by 1""",
    "export_fk_check": " union all ".join([_FK("article_events.article_id", "article_events", "article_id", "articles", "article_id"), _FK("article_semantic_ids.article_id", "article_semantic_ids", "article_id", "articles", "article_id"), _FK("documents.article_id", "documents", "article_id", "articles", "article_id"), _FK("doc_labels.doc_id", "doc_labels", "doc_id", "documents", "doc_id"), _FK("behaviors.user_id", "behaviors", "user_id", "history", "user_id")]),
    "unique_key_check": " union all ".join(f"select '{t}' table_name, count(*) filter ({k} is null) null_keys, count({k}) - count(distinct {k}) repeated_keys from {t}" for t, k in (("articles", "article_id"), ("behaviors", "impression_id"), ("history", "user_id"), ("article_semantic_ids", "article_id"), ("documents", "doc_id"))),
    "json_props": "select event_type, count(*) n, count(k) with_k, cast(sum(k) as bigint) sum_k, min(k) min_k, max(k) max_k from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) k from events) group by 1",
    "schema_merge_union": """select 'article' kind, count(*) n, cast(0 as bigint) with_source, cast(sum(length(title)) as bigint) title_chars, cast(null as bigint) n_chars from articles
union all select 'document', count(*), count(source), null, cast(sum(n_chars) as bigint) from documents""",
    "user_sessions": """with f as (select *, case when ts - lag(ts) over w > interval 30 minutes or lag(ts) over w is null then 1 else 0 end head from events where user_id is not null and ts is not null window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(head) over (partition by user_id order by ts, event_id rows unbounded preceding) session from f)
select user_id, cast(session as bigint) session, count(*) n_events, min(ts) first_ts, max(ts) last_ts from s group by user_id, session""",
}
