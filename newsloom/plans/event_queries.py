"""Queries that cluster articles into events and compare clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import catalog as C
from newsloom.operators import compare as X
from newsloom.operators import entities as E
from newsloom.operators import events as V
from newsloom.plans.base import HIGH_DF, behaviors, history
from newsloom.plans.catalog_queries import train_ids, valid
from newsloom.plans.entity_queries import RESPELLED, respelled
from newsloom.plans.entity_queries import WITH as ENTITIES
from newsloom.runtime import Scratch

THETA, HOURS = 0.3, 72


def _sets(spark: SparkSession, d: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Train articles with their times, and distinct (article, entity) of all articles."""
    b = base_tables(spark, d, scratch)
    return b["train"], scratch.keep(E.entity_sets(E.article_entities(b["mentions"])))


def base_tables(spark: SparkSession, d: str, scratch: Scratch) -> dict[str, DataFrame]:
    """Valid articles, the ids train uses and the mentions, each written once for all stages of a run."""
    va = scratch.keep(valid(spark, d))
    ids = scratch.keep(C.used_ids(behaviors(spark, d, "train"), history(spark, d), False).join(va.select("article_id"), "article_id", "left_semi"))
    train = scratch.keep(va.select("article_id", "published_time").join(ids, "article_id", "left_semi"))
    return {"valid": va, "train_ids": ids, "train": train, "mentions": scratch.keep(E.mentions(va, ids))}


def clustered(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    scratch = Scratch(spark, "events")
    b = base_tables(spark, d, scratch)
    sets = scratch.keep(E.entity_sets(E.article_entities(b["mentions"])))
    return V.cluster_events(b["train"], sets, scratch, THETA, HOURS, HIGH_DF) | b | {"sets": sets, "scratch": scratch}


def compared(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The respelled mentions (see ``entity_queries.respelled``) clustered as they are and normalised."""
    scratch = Scratch(spark, "compare")
    b = base_tables(spark, d, scratch)
    e = scratch.keep(E.article_entities(scratch.keep(respelled(b["mentions"]))))
    out = []
    for key in ("baseline_entity_key", "canonical_entity_key"):
        sets = scratch.keep(E.entity_sets(e, key))
        out.append(V.cluster_events(b["train"], sets, scratch, THETA, HOURS, HIGH_DF) | b | {"sets": sets, "scratch": scratch, "entities": e})
    X.require_same_articles(out[0]["article_events"], out[1]["article_events"])
    return out[0], out[1]


def entity_idf(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "idf")
    train, sets = _sets(spark, d, scratch)
    idf = V.entity_idf(sets.join(train, "article_id", "left_semi"), train.count(), HIGH_DF)
    return idf.select("entity", "document_frequency", F.round("document_frequency_ratio", 6).alias("document_frequency_ratio"), F.round("idf", 6).alias("idf"), "is_high_df")


def high_df_entities(spark: SparkSession, d: str) -> DataFrame:
    return entity_idf(spark, d).where("is_high_df").select("entity", "document_frequency")


def time_pair_count(spark: SparkSession, d: str) -> DataFrame:
    return V.pairs_in_window(valid(spark, d).join(train_ids(spark, d), "article_id", "left_semi"), HOURS)


def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "edges")
    train, sets = _sets(spark, d, scratch)
    return V.similarity_edges(train, sets, scratch, THETA, HOURS, HIGH_DF)["edges"].select("a", "b", F.round("sim", 6).alias("sim"))


def article_events(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d)["article_events"]


def event_master(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d)["event_master"].withColumn("event_entities", F.array_join("event_entities", "|"))


def event_run_stats(spark: SparkSession, d: str) -> DataFrame:
    """Edges, events, singletons, largest event, articles without entities, and those with frequent entities only."""
    c = clustered(spark, d)
    m = c["event_master"]
    some = c["sets"].select("article_id").distinct()
    useful = c["csets"].select("article_id").distinct()
    row = m.agg(F.count("*").alias("n_events"), F.count_if(F.col("event_article_count") == 1).alias("n_singletons"), F.max("event_article_count").alias("largest"), F.sum("event_article_count").alias("n_articles"))
    row = row.withColumn("n_edges", c["edges"].agg(F.count("*")).scalar())
    row = row.withColumn("without_entities", c["train"].join(some, "article_id", "left_anti").agg(F.count("*")).scalar())
    return row.withColumn("frequent_only", c["train"].join(some, "article_id", "left_semi").join(useful, "article_id", "left_anti").agg(F.count("*")).scalar())


def event_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Counts that must all be 0."""
    c = clustered(spark, d)
    m, a = c["event_master"], c["article_events"]
    row = m.agg(
        F.count_if(F.col("event_start_time") > F.col("event_last_added_time")).alias("start_after_last"),
        F.count_if(F.col("event_id").isNull() | F.col("first_article_id").isNull()).alias("nulls"),
        (F.max("event_id") + 1 - F.count("*")).alias("gaps"),
    )
    counted = a.groupBy("event_id").agg(F.count("*").alias("n")).join(m, "event_id", "full_outer").agg(F.count_if(~F.col("n").eqNullSafe(F.col("event_article_count"))))
    return row.withColumn("count_mismatch", counted.scalar()).withColumn("repeated_articles", a.agg(F.count("*") - F.count_distinct("article_id")).scalar())


def _assigned(spark: SparkSession, d: str, c: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    c = c or clustered(spark, d)
    s = c["scratch"]
    later = C.used_ids(behaviors(spark, d, "validation"), history(spark, d), True)
    late = s.keep(c["valid"].select("article_id", "published_time").join(later, "article_id", "left_semi").join(c["train"], "article_id", "left_anti"))
    return c, s.keep(V.assign_events(late, c["sets"], c["idf"], c["event_master"], c["train"].count(), s, THETA, HOURS))


def validation_events(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)[1].select("article_id", "event_id", F.lit("validation").alias("assignment_split"), "published_time")


def events_with_validation(spark: SparkSession, d: str) -> DataFrame:
    c, a = _assigned(spark, d)
    return V.extended_master(c["event_master"], a)


def validation_event_summary(spark: SparkSession, d: str) -> DataFrame:
    """Later articles that joined a train event, a new event, or made one; checked against the number of articles."""
    return _assignment_summary(events_with_validation(spark, d))


def _assignment_summary(m: DataFrame) -> DataFrame:
    n = F.col("validation_article_count")
    return m.agg(
        F.sum(F.when(F.col("event_origin_split") == "train", n).otherwise(0)).alias("matched_train"),
        F.sum(F.when(F.col("event_origin_split") == "validation", F.greatest(n - 1, F.lit(0))).otherwise(0)).alias("matched_validation"),
        F.count_if(F.col("event_origin_split") == "validation").alias("new_events"),
        F.sum(n).alias("n_articles"),
        F.count("*").alias("final_events"),
    )


def assignment_run_stats(spark: SparkSession, d: str) -> DataFrame:
    """What the ordered assignment looked at: pairs within the window, pairs similar enough, articles without entities and without any that isn't too frequent."""
    c, a = _assigned(spark, d)
    sets, frequent = c["sets"], c["idf"].where("is_high_df").select("entity")
    ids = a.select("article_id")
    some, useful = sets.select("article_id").distinct(), sets.join(frequent, "entity", "left_anti").select("article_id").distinct()
    row = V.pairs_looked_at(c["event_master"], a, c["scratch"], HOURS)
    row = row.withColumn("similar_pairs", a.agg(F.coalesce(F.sum("alike"), F.lit(0))).scalar())
    row = row.withColumn("without_entities", ids.join(some, "article_id", "left_anti").agg(F.count("*")).scalar())
    return row.withColumn("without_useful_entities", ids.join(useful, "article_id", "left_anti").agg(F.count("*")).scalar())


def assignment_groups(spark: SparkSession, d: str) -> DataFrame:
    """How many groups of each size were folded at once."""
    sizes = _assigned(spark, d)[1].groupBy("component").agg(F.count("*").alias("n_articles"))
    return sizes.groupBy("n_articles").agg(F.count("*").alias("n_groups"))


def _master(c: dict[str, DataFrame], ids: DataFrame, events: DataFrame) -> DataFrame:
    s, va = c["scratch"], c["valid"]
    mapping = s.keep(C.category_mapping(va.join(c["train_ids"], "article_id", "left_semi")))
    return C.article_master(ids, C.with_category(va, mapping), C.embedding_input(va, s), events)


def article_master(spark: SparkSession, d: str) -> DataFrame:
    c = clustered(spark, d)
    return _master(c, c["train"].select("article_id"), c["article_events"])


def validation_article_master(spark: SparkSession, d: str) -> DataFrame:
    c, a = _assigned(spark, d)
    return _master(c, a.select("article_id"), a)


def master_defects(spark: SparkSession, d: str) -> DataFrame:
    return C.master_defects(article_master(spark, d), valid(spark, d).count())


def cluster_size_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.size_summary(clustered(spark, d)["article_events"])


def idf_diff(spark: SparkSession, d: str) -> DataFrame:
    l, r = compared(spark, d)
    return X.idf_diff(l["idf"], r["idf"])


def cocluster_pair_diff(spark: SparkSession, d: str) -> DataFrame:
    l, r = compared(spark, d)
    return X.pair_diff(l["article_events"], r["article_events"])


def merge_split_events(spark: SparkSession, d: str) -> DataFrame:
    l, r = compared(spark, d)
    return X.merges_and_splits(l["article_events"], r["article_events"])


def clustering_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Both clusterings by vocabulary, event sizes, later assignment, and what changed between them."""

    def side(c: dict[str, DataFrame]) -> DataFrame:
        row = X.size_summary(c["article_events"])
        row = row.withColumn("vocabulary", c["idf"].agg(F.count("*").cast("double")).scalar()).withColumn("high_df_entities", c["idf"].agg(F.count_if("is_high_df").cast("double")).scalar())
        _, a = _assigned(spark, d, c)
        later = _assignment_summary(V.extended_master(c["event_master"], a))
        for name in ("matched_train", "matched_validation", "new_events", "final_events"):
            row = row.withColumn(name, later.select(F.col(name).cast("double")).scalar())
        return row.withColumn("matched_existing", F.col("matched_train") + F.col("matched_validation"))

    l, r = compared(spark, d)
    s = l["scratch"]
    changed = X.pair_counts(l["article_events"], r["article_events"]).select(F.col("added_pairs").cast("double"), F.col("removed_pairs").cast("double"))
    kinds = X.merges_and_splits(l["article_events"], r["article_events"]).agg(F.count_if(F.col("kind") == "MERGE").cast("double").alias("merged"), F.count_if(F.col("kind") == "SPLIT").cast("double").alias("split"))
    right = s.keep(side(r))
    for one in (changed, kinds):
        right = right.withColumns({c: one.select(c).scalar() for c in one.columns})
    left = s.keep(side(l)).withColumns({x: F.lit(0.0) for x in ("added_pairs", "removed_pairs", "merged", "split")})
    return X.metric_table(left, right)


def pair_details(spark: SparkSession, d: str) -> DataFrame:
    """Changed pairs with what explains them: titles, common entities, those that normalisation aimed at, and each article's changed mentions."""
    l, r = compared(spark, d)
    s, e = l["scratch"], l["entities"]
    p = s.keep(X.pair_diff(l["article_events"], r["article_events"]))
    changed = e.where("baseline_entity_key <> canonical_entity_key")
    targets = changed.where("is_train_used").select(F.col("canonical_entity_key").alias("entity")).distinct().withColumn("target", F.lit(True))
    sets = r["sets"].join(targets, "entity", "left")
    a = sets.select(F.col("article_id").alias("article_a"), "entity", "target")
    b = sets.select(F.col("article_id").alias("article_b"), "entity")
    shared = p.join(a, "article_a").join(b, ["article_b", "entity"]).groupBy("change", "article_a", "article_b").agg(
        F.array_join(F.sort_array(F.collect_list("entity")), "|").alias("common"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("target"), F.col("entity")))), "|").alias("common_normalised")
    )
    moves = changed.groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat("baseline_entity_key", F.lit(" -> "), "canonical_entity_key"))), "|").alias("changes"))
    t = l["valid"].select("article_id", "title").join(moves, "article_id", "left")
    for side in ("a", "b"):
        p = p.join(t.select(F.col("article_id").alias(f"article_{side}"), F.col("title").alias(f"title_{side}"), F.coalesce("changes", F.lit("")).alias(f"changes_{side}")), f"article_{side}")
    return p.join(shared, ["change", "article_a", "article_b"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("common", "common_normalised")})


_names = (
    "entity_idf high_df_entities time_pair_count similarity_edges article_events event_master event_run_stats event_invariants validation_events events_with_validation validation_event_summary assignment_run_stats assignment_groups "
    "article_master validation_article_master master_defects cluster_size_summary idf_diff cocluster_pair_diff merge_split_events clustering_metrics pair_details"
).split()
QUERIES = {n: globals()[n] for n in _names}


def _cluster_sql(p: str, sets: str) -> str:
    """CTEs of one clustering, each name with the prefix ``p``."""
    return f""",
{p}own as materialized (select * from {sets} where article_id in (select article_id from tu)),
{p}idf as materialized (select entity, count(*) document_frequency, count(*) / (select count(*) from tu) document_frequency_ratio, ln(((select count(*) from tu) + 1) / (count(*) + 1)) + 1 idf,
  count(*) / (select count(*) from tu) >= {HIGH_DF} is_high_df from {p}own group by 1),
{p}cs as materialized (select o.article_id, o.entity, i.idf, a.published_time t from {p}own o join {p}idf i using (entity) join va a on a.article_id = o.article_id where not is_high_df),
{p}w as (select article_id, sum(idf) w from {p}cs group by 1),
{p}pairs as materialized (select x.article_id a, y.article_id b, sum(x.idf) inter from {p}cs x join {p}cs y on x.entity = y.entity and (x.t < y.t or (x.t = y.t and x.article_id < y.article_id)) and y.t - x.t <= interval {HOURS} hours group by 1, 2),
{p}edges as materialized (select a, b, round(inter / (l.w + r.w - inter), 9) sim from {p}pairs join {p}w l on l.article_id = a join {p}w r on r.article_id = b where round(inter / (l.w + r.w - inter), 9) >= {THETA}),
{p}both as (select a, b from {p}edges union select b, a from {p}edges),
{p}reach(v, c) as (select distinct a, a from {p}both union select e.b, r.c from {p}reach r join {p}both e on e.a = r.v where r.c < e.b),
{p}mem as materialized (select va.article_id, published_time, coalesce(k.c, va.article_id) c from va left join (select v, min(c) c from {p}reach group by 1) k on k.v = va.article_id where va.article_id in (select article_id from tu)),
{p}head as (select c, min(published_time) event_start_time, arg_min(article_id, (published_time, article_id)) first_article_id, max(published_time) event_last_added_time, count(*) n from {p}mem group by 1),
{p}ev as materialized (select *, row_number() over (order by event_start_time, first_article_id) - 1 event_id from {p}head),
{p}ae as materialized (select article_id, event_id, published_time from {p}mem join {p}ev using (c)),
{p}em as (select event_id, 'train' event_origin_split, event_start_time, event_last_added_time, n event_article_count, n train_article_count, coalesce(names, '') event_entities, coalesce(k, 0) event_entity_count, first_article_id
  from {p}ev left join (select event_id, string_agg(distinct entity, '|' order by entity) names, count(distinct entity) k from {p}cs join {p}ae using (article_id) group by 1) using (event_id)),
{p}sz as (select cast(count(*) as double) events, cast(sum(n) as double) articles, cast(count(*) filter (n = 1) as double) singletons, coalesce(round(count(*) filter (n = 1) / count(*), 6), 0.0) singleton_ratio, cast(count(*) filter (n > 1) as double) multi, round(avg(n), 6) mean_size, cast(median(n) as double) median_size, cast(max(n) as double) largest from {p}ev)"""


def _assign_sql(p: str, sets: str) -> str:
    """CTEs of the ordered assignment after the clustering ``p``: one step an article, the events as a list that each step rewrites."""
    return f""",
{p}en as materialized (select entity, row_number() over (order by entity) k from (select distinct entity from {sets})),
{p}wl as materialized (select list(coalesce(i.idf, ln((select count(*) from tu) + 1) + 1) order by k) ws from {p}en e left join {p}idf i using (entity)),
{p}ar as materialized (select row_number() over (order by published_time, article_id) i, article_id, published_time t, coalesce(ks, []) ks from va left join (select article_id, list(k order by k) ks from {sets} join {p}en using (entity)
  where entity not in (select entity from {p}idf where is_high_df) group by 1) using (article_id) where article_id in (select article_id from vo)),
{p}e0 as materialized (select list({{'id': event_id, 'last': event_last_added_time, 'ks': coalesce(ks, [])}} order by event_id) ev, max(event_id) + 1 top from {p}ev left join (select event_id, list(distinct k) ks from {p}cs join {p}ae using (article_id) join {p}en using (entity) group by 1) using (event_id)),
{p}st(i, article_id, event_id, created, seen, alike, ev, top) as (select 0, cast(null as bigint), cast(null as bigint), false, 0, 0, ev, top from {p}e0
  union all select i, article_id, coalesce(best, top), best is null, seen, len(hits),
    case when best is null then list_append(ev, {{'id': top, 'last': t, 'ks': ks}}) else list_transform(ev, lambda e: case when e.id = best then {{'id': e.id, 'last': t, 'ks': list_distinct(list_concat(e.ks, ks))}} else e end) end, case when best is null then top + 1 else top end
  from (select *, case when len(hits) > 0 then -list_sort(hits, 'DESC')[1].id end best from (
    select *, list_filter(list_transform(open, lambda e: {{'sim': round(list_sum(list_transform(list_intersect(e.ks, ks), lambda x: ws[x])) / list_sum(list_transform(list_distinct(list_concat(e.ks, ks)), lambda x: ws[x])), 9), 'id': -e.id}}), lambda h: h.sim >= {THETA}) hits, len(open) seen from (
      select a.*, s.ev, s.top, w.ws, list_filter(s.ev, lambda e: a.t - e.last >= interval 0 seconds and a.t - e.last <= interval {HOURS} hours) open from {p}st s join {p}ar a on a.i = s.i + 1 cross join {p}wl w)))),
{p}va as materialized (select article_id, event_id, created, seen, alike, t published_time from {p}st join {p}ar using (i, article_id)),
{p}ex as materialized (select event_id, coalesce(m.event_origin_split, 'validation') event_origin_split, coalesce(m.event_start_time, v.vs) event_start_time, greatest(coalesce(m.event_last_added_time, v.vl), coalesce(v.vl, m.event_last_added_time)) event_last_added_time,
  coalesce(m.event_article_count, 0) + coalesce(v.n, 0) event_article_count, coalesce(m.train_article_count, 0) train_article_count, coalesce(v.n, 0) validation_article_count, coalesce(m.first_article_id, v.vf) first_article_id
  from {p}em m full outer join (select event_id, count(*) n, max(published_time) vl, min(published_time) vs, arg_min(article_id, (published_time, article_id)) vf from {p}va group by 1) v using (event_id)),
{p}sm as materialized (select cast(coalesce(sum(validation_article_count) filter (event_origin_split = 'train'), 0) as bigint) matched_train, cast(coalesce(sum(greatest(validation_article_count - 1, 0)) filter (event_origin_split = 'validation'), 0) as bigint) matched_validation,
  count(*) filter (event_origin_split = 'validation') new_events, cast(sum(validation_article_count) as bigint) n_articles, count(*) final_events from {p}ex)"""


WITH = ENTITIES + _cluster_sql("n_", "es")
LATER = WITH + _assign_sql("n_", "es")
_BASE = "(select distinct article_id, baseline_entity_key entity from rn)"
BOTH = RESPELLED + _cluster_sql("n_", "r_es") + _cluster_sql("b_", _BASE)
_MASTER = """select article_id, embedding_row, model_category_id, event_id, vc.published_time, model_text from {ids} join vc using (article_id)
  join (select article_id, row_number() over (order by article_id) - 1 embedding_row from va) using (article_id) join (select article_id, event_id from {events}) using (article_id)"""
_DIFF = """(select 'ADDED' change, x.article_id article_a, y.article_id article_b, bx.event_id left_event_a, by_.event_id left_event_b, x.event_id right_event_a, y.event_id right_event_b from n_ae x join n_ae y on x.event_id = y.event_id and x.article_id < y.article_id
    join b_ae bx on bx.article_id = x.article_id join b_ae by_ on by_.article_id = y.article_id where bx.event_id <> by_.event_id
  union all select 'REMOVED', x.article_id, y.article_id, x.event_id, y.event_id, nx.event_id, ny.event_id from b_ae x join b_ae y on x.event_id = y.event_id and x.article_id < y.article_id
    join n_ae nx on nx.article_id = x.article_id join n_ae ny on ny.article_id = y.article_id where nx.event_id <> ny.event_id)"""
_SZ = ("events", "articles", "singletons", "singleton_ratio", "multi", "mean_size", "median_size", "largest")


def _metric_sql(name: str, left: str, right: str) -> str:
    return f"select '{name}' metric, l left_value, r right_value, round(r - l, 6) delta, case when l <> 0 then round((r - l) / l, 6) end ratio from (select cast({left} as double) l, cast({right} as double) r)"


_BOTH_SIDES = {
    **{c: "(select " + c + " from {p}sz)" for c in _SZ}, "vocabulary": "(select count(*) from {p}idf)", "high_df_entities": "(select count(*) from {p}idf where is_high_df)",
    **{c: "(select " + c + " from {p}sm)" for c in ("matched_train", "matched_validation", "new_events", "final_events")}, "matched_existing": "(select matched_train + matched_validation from {p}sm)",
}
_SPANS = "(select {a}.event_id from {a}_ae {a} join {b}_ae {b} using (article_id) group by 1 having count(distinct {b}.event_id) > 1)"
_CHANGES = {
    "added_pairs": f"(select count(*) from {_DIFF} where change = 'ADDED')", "removed_pairs": f"(select count(*) from {_DIFF} where change = 'REMOVED')",
    "merged": f"(select count(*) from {_SPANS.format(a='n', b='b')})", "split": f"(select count(*) from {_SPANS.format(a='b', b='n')})",
}
SQL = {
    "entity_idf": WITH + "select entity, document_frequency, round(document_frequency_ratio, 6) document_frequency_ratio, round(idf, 6) idf, is_high_df from n_idf",
    "high_df_entities": WITH + "select entity, document_frequency from n_idf where is_high_df",
    "time_pair_count": WITH + f"select count(*) n_pairs from va x join va y on (x.published_time < y.published_time or (x.published_time = y.published_time and x.article_id < y.article_id)) and y.published_time - x.published_time <= interval {HOURS} hours where x.article_id in (select article_id from tu) and y.article_id in (select article_id from tu)",
    "similarity_edges": WITH + "select a, b, round(sim, 6) sim from n_edges",
    "article_events": WITH + "select article_id, event_id, 'train' assignment_split, published_time from n_ae",
    "event_master": WITH + "select * from n_em",
    "event_run_stats": WITH + """select count(*) n_events, count(*) filter (n = 1) n_singletons, max(n) largest, cast(sum(n) as bigint) n_articles, (select count(*) from n_edges) n_edges,
  (select count(*) from tu where article_id not in (select article_id from es)) without_entities, (select count(*) from tu where article_id in (select article_id from es) and article_id not in (select article_id from n_cs)) frequent_only from n_ev""",
    "event_invariants": WITH + """select (select count(*) from n_em where event_start_time > event_last_added_time) start_after_last, (select count(*) from n_em where event_id is null or first_article_id is null) nulls,
  (select max(event_id) + 1 - count(*) from n_em) gaps, (select count(*) from n_em full outer join (select event_id, count(*) n from n_ae group by 1) using (event_id) where n is distinct from event_article_count) count_mismatch,
  (select count(*) - count(distinct article_id) from n_ae) repeated_articles""",
    "validation_events": LATER + "select article_id, event_id, 'validation' assignment_split, published_time from n_va",
    "events_with_validation": LATER + "select * from n_ex",
    "validation_event_summary": LATER + "select * from n_sm",
    "assignment_run_stats": LATER + """, seen as (select cast(sum(seen) as bigint) time_pairs, cast(sum(alike) as bigint) similar_pairs from n_va)
  select time_pairs, similar_pairs, (select count(*) from vo where article_id not in (select article_id from es)) without_entities, (select count(*) from n_ar where len(ks) = 0) without_useful_entities from seen""",
    "validation_article_master": LATER + _MASTER.format(ids="vo", events="n_va"),
    "article_master": WITH + _MASTER.format(ids="tu", events="n_ae"),
    "master_defects": WITH + f""", ms as (select * from tu left join ({_MASTER.format(ids="tu", events="n_ae")}) using (article_id))
  select count(*) filter (embedding_row is null or event_id is null or published_time is null) null_rows, count(*) - count(distinct article_id) repeated_ids, count(*) filter (model_text is null or trim(model_text) = '') blank_texts,
  count(*) filter (embedding_row < 0 or embedding_row >= (select count(*) from va)) rows_out_of_range from ms""",
    "cluster_size_summary": WITH + "select * from n_sz",
    "idf_diff": BOTH + """select entity, change, left_df, right_df from (select coalesce(l.entity, r.entity) entity, l.document_frequency left_df, r.document_frequency right_df,
  case when l.entity is null then 'VOCABULARY_ADDED' when r.entity is null then 'VOCABULARY_REMOVED' when not l.is_high_df and r.is_high_df then 'BECAME_HIGH_DF' when l.is_high_df and not r.is_high_df then 'LEFT_HIGH_DF'
  when l.document_frequency <> r.document_frequency then 'DF_CHANGED' end change from b_idf l full outer join n_idf r on l.entity = r.entity) where change is not null""",
    "cocluster_pair_diff": BOTH + "select * from " + _DIFF,
    "merge_split_events": BOTH + """select 'MERGE' kind, r.event_id, count(distinct l.event_id) n, count(*) n_articles from b_ae l join n_ae r using (article_id) group by 2 having count(distinct l.event_id) > 1
  union all select 'SPLIT', l.event_id, count(distinct r.event_id), count(*) from b_ae l join n_ae r using (article_id) group by 2 having count(distinct r.event_id) > 1""",
    "clustering_metrics": BOTH + _assign_sql("n_", "r_es") + _assign_sql("b_", _BASE)
    + " union all ".join([_metric_sql(n, e.format(p="b_"), e.format(p="n_")) for n, e in _BOTH_SIDES.items()] + [_metric_sql(n, "0", e) for n, e in _CHANGES.items()]),
    "pair_details": BOTH + f""", ch as (select article_id, baseline_entity_key b, canonical_entity_key c, is_train_used from r_ae where baseline_entity_key <> canonical_entity_key),
  tg as (select distinct c entity from ch where is_train_used), mv as (select article_id, string_agg(x, '|' order by x) changes from (select distinct article_id, b || ' -> ' || c x from ch) group by 1)
  select df.*, a.title title_a, b.title title_b, coalesce(ca.changes, '') changes_a, coalesce(cb.changes, '') changes_b,
  coalesce((select string_agg(x.entity, '|' order by x.entity) from r_es x join r_es y using (entity) where x.article_id = article_a and y.article_id = article_b), '') common,
  coalesce((select string_agg(x.entity, '|' order by x.entity) from r_es x join r_es y using (entity) join tg using (entity) where x.article_id = article_a and y.article_id = article_b), '') common_normalised
  from {_DIFF} df join va a on a.article_id = article_a join va b on b.article_id = article_b left join mv ca on ca.article_id = article_a left join mv cb on cb.article_id = article_b""",
}
