"""Queries that link entities: short forms, a knowledge base drawn from the corpus, context scores, decisions.

No outside knowledge base is at hand.  The candidates of an entity are the first
ten entities of its group that share its key word (a person's last word, else the
first), as a search gives so many hits; a candidate's description is the least
title it stands in, and its class is drawn from its length over a small class
graph with a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import linking as L
from newsloom.operators import search as K
from newsloom.functions.text import casefold_nfkc
from newsloom.operators.entities import LINK_STOP_WORDS, entity_sets
from newsloom.operators.graph import ancestors
from newsloom.operators.sampling import diverse_sample
from newsloom.plans.base import _nfkc_sql
from newsloom.plans.catalog_queries import valid
from newsloom.plans.entity_queries import _TOK, _q, _entities
from newsloom.plans.entity_queries import WITH as ENTITIES
from newsloom.runtime import Scratch
from newsloom.sources import load

CLASS_EDGES = [("K0", "Q5"), ("K1", "K0"), ("K2", "K1"), ("K3", "Q43229"), ("K4", "K3"), ("K5", "Q486972"), ("K6", "K6")]
#: Hits that a search gives at most.
HITS = 10
METRICS = ["short_df", "long_df", "n_articles", "n_events", "n_context", "jaccard", "score"]


def _train(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    return scratch.keep(_entities(spark, d).where("is_train_used"))


def entity_universe(spark: SparkSession, d: str) -> DataFrame:
    return L.universe(_entities(spark, d))


def pending_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities without a final search status; the status of earlier runs is drawn from the key's length."""
    u = L.universe(_entities(spark, d), ["PER", "ORG"])
    done = u.select("canonical_entity_key", F.element_at(F.array(F.lit("FOUND"), F.lit("NO_CANDIDATE"), F.lit("ERROR")), F.length("canonical_entity_key") % 3 + 1).alias("status"))
    return L.pending(u, done)


def _pairs(t: DataFrame) -> DataFrame:
    return L.short_long_candidates(t.select("entity_group", F.col("canonical_entity").alias("entity")).distinct())


def short_long_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(_train(spark, d, Scratch(spark, "links")))


def ambiguous_short_forms(spark: SparkSession, d: str) -> DataFrame:
    """Short forms that several long forms compete for."""
    return short_long_candidates(spark, d).groupBy("entity_group", "short").agg(F.count("*").alias("n_longs"), F.array_join(F.sort_array(F.collect_list("long")), "|").alias("longs")).where("n_longs > 1")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "links")
    t = _train(spark, d, scratch)
    return scratch.keep(L.evidence(_pairs(t), entity_sets(t), load(spark, d, "article_events")))


def link_evidence(spark: SparkSession, d: str) -> DataFrame:
    return L.numbered_candidates(_evidence(spark, d), Scratch(spark, "links"))


def evidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    t = L.tier(_evidence(spark, d))
    return t.groupBy("tier", "entity_group").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def tiered_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with tier, coverage and what is reviewed first, in the order of review."""
    return L.tiered(_evidence(spark, d)).orderBy(*L.review_order())


def tier_statistics(spark: SparkSession, d: str) -> DataFrame:
    return L.tier_statistics(L.tiered(_evidence(spark, d)))


def context_profile(spark: SparkSession, d: str) -> DataFrame:
    """Articles, mentions, events and neighbours of each train entity."""
    return L.context_profile(_train(spark, d, Scratch(spark, "links")), load(spark, d, "article_events"))


def metric_quantiles(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d)
    return L.metric_quantiles(e.select("entity_group", *[F.col(c).cast("double").alias(c) for c in METRICS]), METRICS)


def _candidates(spark: SparkSession, d: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Train mentions, and candidates of each entity with rank, label and description."""
    t = _train(spark, d, scratch)
    v = scratch.keep(_described(t, valid(spark, d)))
    other = v.select("entity_group", "word", F.col("canonical_entity").alias("label"), F.concat(F.lit("Q:"), "canonical_entity_key").alias("qid"), "description", F.col("df").alias("c_df"))
    w = Window.partitionBy("entity_group", "word").orderBy(F.desc("c_df"), "label")
    hits = other.withColumn("candidate_rank", F.row_number().over(w).cast("bigint")).where(F.col("candidate_rank") <= HITS)
    c = v.select("entity_group", "word", "canonical_entity", "canonical_entity_key").join(hits, ["entity_group", "word"])
    return t, scratch.keep(c.select("entity_group", "canonical_entity", "canonical_entity_key", "qid", "label", "description", "candidate_rank"))


def _hits(spark: SparkSession, d: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Train entities, hits of their search in two languages, entities whose search failed, and train mentions.

    An entity's hits are other entities of its key word, in Danish the most
    frequent first, in English by name; searches for very long names fail.
    """
    t, _ = _candidates(spark, d, scratch)
    u = scratch.keep(L.universe(t))
    v = scratch.keep(_described(t, valid(spark, d)))
    parts = []
    for language, order in (("da", [F.desc("df"), "canonical_entity"]), ("en", ["canonical_entity"])):
        w = Window.partitionBy("entity_group", "word").orderBy(*order)
        parts.append(v.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= HITS).select("entity_group", "word", F.lit(language).alias("language"), "rank", F.concat(F.lit("Q:"), "canonical_entity_key").alias("qid"), F.col("canonical_entity").alias("label"), "description"))
    hits = v.select("entity_group", "canonical_entity", "canonical_entity_key", "word").join(parts[0].unionByName(parts[1]), ["entity_group", "word"]).where("label <> canonical_entity").withColumn("match_text", F.col("label"))
    failed = u.where(F.length("canonical_entity") > 24).select("canonical_entity_key")
    hits = hits.join(failed, "canonical_entity_key", "left_anti")
    return u, scratch.keep(hits.drop("word")), scratch.keep(failed), t


def _described(t: DataFrame, articles: DataFrame) -> DataFrame:
    """Train entities with their frequency, key word and the least title they stand in."""
    v = t.join(articles.select("article_id", "title"), "article_id").groupBy("entity_group", "canonical_entity", "canonical_entity_key").agg(F.count_distinct("article_id").alias("df"), F.min("title").alias("description"))
    words = F.split("canonical_entity", " ")
    return v.withColumn("word", F.when(F.col("entity_group") == "PER", F.element_at(words, -1)).otherwise(F.element_at(words, 1)))


def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    """One row a hit, an id once, in the order of languages and ranks."""
    return K.first_seen(_hits(spark, d, Scratch(spark, "search"))[1])


def search_status(spark: SparkSession, d: str) -> DataFrame:
    u, hits, failed, _ = _hits(spark, d, Scratch(spark, "search"))
    return K.search_status(u, K.first_seen(hits), failed)


def search_summary(spark: SparkSession, d: str) -> DataFrame:
    """Searched entities by group and status."""
    return K.status_summary(search_status(spark, d))


def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Hits of both languages merged: by best rank, language and id."""
    return K.merged(_hits(spark, d, Scratch(spark, "search"))[1]).withColumn("matched_texts", F.array_join("matched_texts", "|"))


def type_filter_summary(spark: SparkSession, d: str) -> DataFrame:
    """Searched entities and candidates by group and what the type filter says."""
    return type_filter_status(spark, d).groupBy("entity_group", "policy", "filter_status").agg(F.count("*").alias("n_entities"), F.sum("n_candidates").alias("n_candidates"), F.count("one_match_qid").alias("n_one_match"))


def probe_entities(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the twelve most frequent entities; the number is the feature."""
    u, hits, _, _ = _hits(spark, d, Scratch(spark, "probe"))
    return K.probed(u.orderBy(F.desc("article_df"), "canonical_entity_key").limit(12), hits)


def link_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What is asked of a decision at once: eight entities of an article, what else it names, its texts whole."""
    t = _train(spark, d, Scratch(spark, "payload"))
    return K.payload_chunks(K.entity_pairs(t), K.context_map(valid(spark, d), ["subtitle", "body"]))


def link_cost(spark: SparkSession, d: str) -> DataFrame:
    """Price of all requests, taking four characters for a token, the titles for cached and twenty tokens for an answer."""
    p = link_payloads(spark, d)
    chars = F.length("title") + F.length("context") + F.length("entity_keys") + F.length("coentities")
    each = p.select(F.floor(chars / 4).alias("read"), F.floor(F.length("title") / 4).alias("cached"), (F.col("n_targets") * 20).alias("written"))
    sums = each.agg(F.count("*").alias("n_requests"), *[F.sum(c).alias(c) for c in ("read", "cached", "written")])
    return sums.withColumn("cost", F.round(K.token_cost(F.col("read"), F.col("cached"), F.col("written")), 6))


def knowledge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, Scratch(spark, "links"))[1]


def _subclass(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASS_EDGES, "child string, parent string")


def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    """Everything above each class within eight steps, itself included."""
    e = _subclass(spark)
    return ancestors(e, e.select(F.col("child").alias("node")), Scratch(spark, "links"))


def type_filter_status(spark: SparkSession, d: str) -> DataFrame:
    """Entities by how many of their candidates are of the right type."""
    scratch = Scratch(spark, "links")
    u, hits, failed, _ = _hits(spark, d, scratch)
    c = scratch.keep(K.first_seen(hits))
    classes = c.select("qid", F.length("label").alias("n")).distinct().where("n % 11 <> 0").select("qid", F.concat(F.lit("K"), (F.col("n") % 7).cast("string")).alias("class"))
    typed = L.class_filter(c.select("entity_group", "canonical_entity_key", "qid", "label"), classes, _subclass(spark), scratch)
    return L.filter_summary(typed, K.search_status(u, c, failed))


def _article_tokens(articles: DataFrame) -> DataFrame:
    """Words of title, subtitle and body, whole, in compatibility form and folded case.  The SQL twin reads the first 3 000 characters only, so the two differ on longer texts."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "subtitle", "body")])
    return articles.select("article_id", L.context_tokens(casefold_nfkc(text)).alias("article_tokens"))


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "links")
    t, c = _candidates(spark, d, scratch)
    texts = _article_tokens(valid(spark, d))
    cases = t.select("article_id", "canonical_entity_key").distinct().join(c, "canonical_entity_key").join(texts, "article_id")
    # a candidate's texts are folded once, not once a case
    folded = c.select("qid", "label", "description").distinct().select("qid", casefold_nfkc("label").alias("folded_label"), casefold_nfkc("description").alias("folded_description"))
    cases = cases.join(folded, "qid").withColumns({"surface": F.col("canonical_entity"), "label": F.col("folded_label"), "match_text": F.col("folded_label"), "label_tokens": L.context_tokens(F.col("folded_label")), "description_tokens": L.context_tokens(F.col("folded_description"))})
    return scratch.keep(L.context_scores(cases).select("article_id", "canonical_entity_key", "entity_group", "qid", "candidate_rank", "context_score")), t, c


def context_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)[0].withColumn("context_score", F.round("context_score", 6))


def context_status(spark: SparkSession, d: str) -> DataFrame:
    return L.context_status(_scores(spark, d)[0], ["article_id", "canonical_entity_key"])


def entity_consistency(spark: SparkSession, d: str) -> DataFrame:
    return L.consistency(L.context_status(_scores(spark, d)[0], ["article_id", "canonical_entity_key"]), "canonical_entity_key")


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, t, c = _scores(spark, d)
    st = L.context_status(s, ["article_id", "canonical_entity_key"])
    n, clear = F.length("canonical_entity_key"), F.col("status").isin("SINGLE", "UNIQUE_TOP")
    # decisions as a careless judge gives them: some are missing, repeated, or name an id that wasn't offered
    given = st.select(
        "article_id", "canonical_entity_key", F.when(clear, "LINKED").otherwise("UNLINKED").alias("decision"), F.when(n % 5 == 0, F.lit("Q:not a candidate")).when(clear, F.col("top_qid")).alias("selected_qid"),
        F.when(clear, "HIGH").otherwise("MEDIUM").alias("confidence"), F.col("status").alias("reason"),
    )
    decisions = given.where(n % 7 != 0).unionByName(given.where((n % 7 != 0) & (n % 11 == 0)))
    repairs = st.where(n % 2 == 0).select("article_id", "canonical_entity_key", F.lit("LINKED").alias("decision"), F.col("top_qid").alias("selected_qid"), F.lit("MEDIUM").alias("confidence"), F.lit("repaired").alias("reason"))
    return K.resolved(t, c, decisions, repairs), t


def decision_report(spark: SparkSession, d: str) -> DataFrame:
    """Links by how they came about."""
    return _links(spark, d)[0].groupBy("resolution_source", "decision", "confidence", "reason").agg(F.count("*").alias("n_links"))


def link_rows(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)[0]


def linked_entities(spark: SparkSession, d: str) -> DataFrame:
    """Final entities of each valid article; articles without any stay, with none."""
    links, _ = _links(spark, d)
    n = links.groupBy("article_id").agg(F.count_distinct("linked_entity_key").alias("n_entities"), F.count_if(F.col("decision") == "LINKED").alias("n_linked"), F.array_join(F.sort_array(F.collect_set("linked_entity_key")), "|").alias("entities"))
    return valid(spark, d).select("article_id").join(n, "article_id", "left").fillna(0, ["n_entities", "n_linked"]).fillna("", ["entities"])


def link_backjoin(spark: SparkSession, d: str) -> DataFrame:
    """Each train mention with the link of its article and key."""
    links, t = _links(spark, d)
    return t.select("article_id", "entity_position", "canonical_entity_key").join(links.select("article_id", "canonical_entity_key", "decision", "linked_entity_key"), ["article_id", "canonical_entity_key"], "left")


def scope_articles(spark: SparkSession, d: str) -> DataFrame:
    """At most 200 articles to process, half of them train ones; the limit is the feature."""
    e = _entities(spark, d).groupBy("article_id").agg(F.bool_or("is_train_used").alias("is_train_used"))
    return L.scope_ids(e, 200, Scratch(spark, "scope"))


def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """For review: 30 cases of each status spread over the scores, at most 2 of an entity; the limit is the feature."""
    st = L.context_status(_scores(spark, d)[0], ["article_id", "canonical_entity_key"])
    s = diverse_sample(st, "status", "canonical_entity_key", [F.desc("top_score"), "article_id", "canonical_entity_key"], 30, 2, Scratch(spark, "sample"))
    return s.select("status", "sample_rank", "article_id", "canonical_entity_key", "top_qid", "top_score")


def review_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 cases in the order of review; the limit is the feature."""
    return K.review_order(L.context_status(_scores(spark, d)[0], ["article_id", "canonical_entity_key"]))


def review_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The sampled cases as rows of a review sheet: title, all candidates as text, and empty columns to fill in."""
    s, t, c = _scores(spark, d)
    case = ["article_id", "canonical_entity_key"]
    st = L.context_status(s, case)
    sample = diverse_sample(st, "status", "canonical_entity_key", [F.desc("top_score"), "article_id", "canonical_entity_key"], 30, 2, Scratch(spark, "sheet"))
    shown = s.join(sample.select(*case), case, "left_semi").join(c.select("canonical_entity_key", "qid", "label", "description"), ["canonical_entity_key", "qid"])
    rows = sample.select("status", "sample_rank", *case, "top_qid").join(K.review_text(shown, case), case).join(valid(spark, d).select("article_id", "title"), "article_id")
    return rows.withColumns({x: F.lit("") for x in ("review_label", "correct_qid", "review_note")})


_names = (
    "entity_universe pending_entities short_long_candidates ambiguous_short_forms link_evidence evidence_tiers tiered_candidates tier_statistics context_profile metric_quantiles search_candidates search_status search_summary "
    "merged_candidates type_filter_summary probe_entities link_payloads link_cost knowledge_candidates ancestor_closure type_filter_status context_scores context_status entity_consistency link_rows decision_report linked_entities link_backjoin scope_articles "
    "review_sample review_examples review_sheet"
).split()
QUERIES = {n: globals()[n] for n in _names}

_STOP = ", ".join(_q(x) for x in L.STOP_WORDS)
_FOLD = lambda x: f"replace(replace(lower({_nfkc_sql(x)}), 'ß', 'ss'), 'ς', 'σ')"
_CTX = lambda x: f"list_distinct(list_filter({_TOK(x)}, lambda y: length(y) >= 2 and y not in ({_STOP})))"
_ASTOP = ", ".join(_q(x) for x in LINK_STOP_WORDS)
_WORDS = f"list_filter(list_transform(regexp_split_to_array(canonical_entity, '\\s+'), lambda y: lower(regexp_replace(y, '[^\\p{{L}}\\p{{N}}]', '', 'g'))), lambda y: y <> '' and y not in ({_ASTOP}))"
_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in CLASS_EDGES)
_ROOTS = ", ".join(f"('{g}', '{r}')" for g, rs in L.TYPE_ROOTS.items() for r in rs)
_GROUPS = ", ".join(f"'{g}'" for g in L.TYPE_ROOTS)
_INTER = lambda a, b: f"len(list_filter({a}, lambda y: list_contains({b}, y)))"
WITH = ENTITIES + f""",
te as materialized (select * from ae where is_train_used),
uni as materialized (select entity_group, canonical_entity, canonical_entity_key, count(distinct article_id) article_df, count(*) mention_count from te group by 1, 2, 3),
sl as materialized (select * from (select entity_group, string_split(canonical_entity, ' ')[-1] short, canonical_entity long from uni where entity_group = 'PER' and contains(canonical_entity, ' ')
  union all select entity_group, array_to_string(list_transform({_WORDS}, lambda x: case when length(x) <= 3 and (regexp_full_match(x, '\\p{{L}}+') or regexp_full_match(x, '\\p{{N}}+')) then x else left(x, 1) end), '') short, canonical_entity from uni where entity_group = 'ORG' and len({_WORDS}) >= 2) c
  where exists (select 1 from uni u where u.entity_group = c.entity_group and u.canonical_entity = c.short) and (entity_group = 'PER' or (length(short) >= 2 and short <> long))),
ts as materialized (select distinct article_id, canonical_entity_key entity from te),
aev as materialized (select distinct entity, event_id from ts join (select distinct article_id, event_id from article_events where article_id is not null and event_id is not null and event_id <> -1) using (article_id)),
bsd as materialized (select distinct x.entity, y.entity other from ts x join ts y using (article_id) where x.entity <> y.entity),
ev0 as materialized (select entity_group, short, long, count(*) over (partition by entity_group, short) competing,
  (select count(*) from ts x join ts y using (article_id) where x.entity = entity_group || '::' || short and y.entity = entity_group || '::' || long) n_articles,
  (select count(*) from aev x join aev y using (event_id) where x.entity = entity_group || '::' || short and y.entity = entity_group || '::' || long) n_events,
  (select count(*) from bsd x join bsd y using (other) where x.entity = entity_group || '::' || short and y.entity = entity_group || '::' || long) n_context,
  (select count(*) from ts where entity = entity_group || '::' || short) short_df, (select count(*) from ts where entity = entity_group || '::' || long) long_df,
  (select count(*) from aev where entity = entity_group || '::' || short) short_events, (select count(*) from aev where entity = entity_group || '::' || long) long_events,
  (select count(*) from bsd x where x.entity = entity_group || '::' || short) ns, (select count(*) from bsd x where x.entity = entity_group || '::' || long) nl from sl),
ev1 as (select *, case when ns + nl - n_context > 0 then n_context / (ns + nl - n_context) else 0.0 end j from ev0),
ev as materialized (select entity_group, short, long, competing, short_df, long_df, short_events, long_events, n_articles, n_events, n_context, round(j, 6) jaccard, round(3.0 * n_articles + 1.5 * n_events + 5.0 * j - 2.0 * greatest(competing - 1, 0), 6) score from ev1),
kv as materialized (select u.*, case when entity_group = 'PER' then string_split(canonical_entity, ' ')[-1] else string_split(canonical_entity, ' ')[1] end word, ds.description
  from uni u join (select canonical_entity_key, min(title) description from te join va using (article_id) group by 1) ds using (canonical_entity_key)),
kc as materialized (select a.entity_group, a.canonical_entity, a.canonical_entity_key, 'Q:' || b.canonical_entity_key qid, b.canonical_entity \"label\", b.description, candidate_rank
  from kv a join (select *, row_number() over (partition by entity_group, word order by article_df desc, canonical_entity) candidate_rank from kv) b on a.entity_group = b.entity_group and a.word = b.word and candidate_rank <= {HITS}),
clo(node, ancestor, depth) as (select distinct child, child, 0 from (values {_EDGES}) e(child, parent) union select c.node, e.parent, c.depth + 1 from clo c join (values {_EDGES}) e(child, parent) on e.child = c.ancestor where c.depth < 8),
cl as (select node, ancestor, min(depth) depth from clo group by 1, 2),
hr as (select *, row_number() over (partition by entity_group, word order by article_df desc, canonical_entity) rda, row_number() over (partition by entity_group, word order by canonical_entity) ren from kv),
hi as materialized (select a.entity_group, a.canonical_entity, a.canonical_entity_key, h.language, h.rank, 'Q:' || h.k qid, h.l \"label\", h.description from kv a join (
    select entity_group, word, 'da' language, rda rank, canonical_entity_key k, canonical_entity l, description from hr where rda <= {HITS} union all select entity_group, word, 'en', ren, canonical_entity_key, canonical_entity, description from hr where ren <= {HITS}) h
  on h.entity_group = a.entity_group and h.word = a.word where h.l <> a.canonical_entity and length(a.canonical_entity) <= 24),
fs as materialized (select entity_group, canonical_entity, canonical_entity_key, row_number() over (partition by canonical_entity_key order by language, rank, qid) candidate_rank, qid, \"label\", description, language search_language, rank search_rank, \"label\" match_text
  from (select *, row_number() over (partition by canonical_entity_key, qid order by language, rank) nth from hi) where nth = 1),
ss as materialized (select uni.*, case when length(canonical_entity) > 24 then 'ERROR' when coalesce(n, 0) > 0 then 'FOUND' else 'NO_CANDIDATE' end status, coalesce(n, 0) candidate_count from uni left join (select canonical_entity_key, count(*) n from fs group by 1) using (canonical_entity_key)),
ty as (select distinct qid, 'K' || (length(\"label\") % 7) class from fs where length(\"label\") % 11 <> 0),
tf as (select fs.entity_group, canonical_entity_key, fs.qid, fs.\"label\", case when fs.entity_group not in ({_GROUPS}) then 'UNCHECKED' when ty.qid is null then 'UNKNOWN'
  when exists (select 1 from cl join (values {_ROOTS}) r(g, root) on r.root = cl.ancestor where cl.node = ty.class and r.g = fs.entity_group) then 'MATCH' else 'MISMATCH' end type_status from fs left join ty using (qid)),
ep as materialized (select distinct article_id, entity_group, canonical_entity, canonical_entity_key from te),
pc as materialized (select *, (row_number() over (partition by article_id order by canonical_entity_key) - 1) // 8 chunk from ep),
pl as materialized (select article_id, chunk, count(*) n_targets, string_agg(canonical_entity_key, '|' order by canonical_entity_key) entity_keys,
  coalesce((select string_agg(x, '|' order by k) from (select o.canonical_entity || ' (' || o.entity_group || ')' x, o.canonical_entity_key k, row_number() over (order by o.canonical_entity_key) r from pc o where o.article_id = p.article_id and o.chunk <> p.chunk) where r <= 30), '') coentities,
  any_value(trim(coalesce(title, ''))) title, any_value(array_to_string(list_filter([trim(coalesce(subtitle, '')), trim(coalesce(body, ''))], lambda x: x <> ''), chr(10) || chr(10))) context from pc p join va using (article_id) group by 1, 2),
atk as materialized (select article_id, {_CTX(_FOLD("left(coalesce(title, '') || ' ' || coalesce(subtitle, '') || ' ' || coalesce(body, ''), 3000)"))} tok from va),
kt as materialized (select *, {_FOLD('"label"')} fl, {_CTX(_FOLD('"label"'))} lt, {_CTX(_FOLD('description'))} dt from kc),
sc as materialized (select x.article_id, kt.canonical_entity_key, entity_group, qid, candidate_rank,
  round((1.0 * (canonical_entity = fl)::int + 0.5 * (fl <> '' and fl = canonical_entity)::int + 1.5 * {_INTER('lt', 'tok')} / greatest(len(lt), 1)
    + 1.0 * (0.7 * {_INTER('dt', 'tok')} / greatest(len(dt), 1) + 0.3 * least({_INTER('dt', 'tok')}, 5) / 5)) / 4.0, 9) context_score
  from ts x join kt on kt.canonical_entity_key = x.entity join atk on atk.article_id = x.article_id),
rk as (select *, row_number() over w place, lead(context_score) over w runner_up, count(*) over (partition by article_id, canonical_entity_key) n,
  max(context_score) over (partition by article_id, canonical_entity_key) best from sc window w as (partition by article_id, canonical_entity_key order by context_score desc, candidate_rank, qid)),
ti as (select article_id, canonical_entity_key, count(*) filter (best - context_score <= 1e-12) ties from rk group by 1, 2),
st as materialized (select rk.article_id, rk.canonical_entity_key, qid top_qid, round(context_score, 6) top_score, round(runner_up, 6) second_score, round(context_score - coalesce(runner_up, 0.0), 6) margin, n n_candidates, ties,
  case when n = 1 then 'SINGLE' when context_score <= 1e-12 then 'ZERO' when ties > 1 then 'TIE' when context_score - coalesce(runner_up, 0.0) >= 0.15 then 'UNIQUE_TOP' else 'WEAK_TOP' end status
  from rk join ti using (article_id, canonical_entity_key) where place = 1),
l0 as (select x.article_id, x.entity canonical_entity_key, coalesce(n, 0) candidate_count, s.top_qid, s.status, s.status in ('SINGLE', 'UNIQUE_TOP') clear, length(x.entity) z
  from ts x left join (select canonical_entity_key, count(distinct qid) n from kc group by 1) k on k.canonical_entity_key = x.entity left join st s on s.article_id = x.article_id and s.canonical_entity_key = x.entity),
l1 as (select *, case when z % 7 = 0 then 'missing decision' when z % 11 = 0 then 'repeated decision' when z % 5 = 0 and clear then 'id that wasn''t offered' when z % 5 = 0 then 'id without a link' end issue from l0),
l2 as (select *, case when candidate_count = 0 then 'NO_CANDIDATE' when issue is null then 'DECISION' when z % 2 = 0 then 'REPAIR' else 'FALLBACK' end resolution_source from l1),
lk as materialized (select article_id, canonical_entity_key, candidate_count, case when (resolution_source = 'DECISION' and clear) or resolution_source = 'REPAIR' then 'LINKED' else 'UNLINKED' end decision,
  case resolution_source when 'DECISION' then case when clear then 'HIGH' else 'MEDIUM' end when 'REPAIR' then 'MEDIUM' when 'FALLBACK' then 'LOW' else 'HIGH' end confidence,
  case resolution_source when 'DECISION' then status when 'REPAIR' then 'repaired' when 'FALLBACK' then issue else 'no candidate' end reason, resolution_source,
  case when (resolution_source = 'DECISION' and clear) or resolution_source = 'REPAIR' then top_qid end selected_qid,
  case when (resolution_source = 'DECISION' and clear) or resolution_source = 'REPAIR' then 'WD::' || top_qid else canonical_entity_key end linked_entity_key from l2)
"""
_SAMPLE = """select status, sample_rank, article_id, canonical_entity_key, top_qid, top_score from (
  select *, row_number() over (partition by status order by visit) sample_rank from (
    select *, row_number() over (partition by status, canonical_entity_key order by visit) e from (
      select *, row_number() over (partition by status order by case when spread then 0 else 1 end, place_at) visit from (
        select *, case when m >= n then true when m = 1 then place_at = n // 2 else round_even(place_at / ((n - 1) / (m - 1)), 0) < m and round_even(round_even(place_at / ((n - 1) / (m - 1)), 0) * ((n - 1) / (m - 1)), 0) = place_at end spread from (
          select *, row_number() over (partition by status order by top_score desc, article_id, canonical_entity_key) - 1 place_at, count(*) over (partition by status) n, least(count(*) over (partition by status), 240) m from st)))) where e <= 2) where sample_rank <= 30"""
_TIERED = """, td as materialized (select *, case left(tier, 2) when 'A1' then 1 when 'A2' then 2 when 'B_' then 3 when 'C1' then 4 when 'C2' then 5 when 'C3' then 6 else 7 end::bigint tier_rank, competing = 1 is_unique_short, case when long_df > 0 then round(n_articles / long_df, 6) else 0.0 end long_coverage,
  case when short_df > 0 then round(n_articles / short_df, 6) else 0.0 end short_coverage, left(tier, 1) = 'A' is_priority, left(tier, 1) = 'C' is_ambiguous from (
  select *, case when competing = 1 and n_articles > 0 then 'A1_UNIQUE_SAME_ARTICLE' when competing = 1 and n_events > 0 then 'A2_UNIQUE_SHARED_EVENT' when competing = 1 and n_context > 0 then 'B_UNIQUE_CONTEXT_ONLY' when competing > 1 and n_articles > 0 then 'C1_AMBIGUOUS_SAME_ARTICLE'
    when competing > 1 and n_events > 0 then 'C2_AMBIGUOUS_SHARED_EVENT' when competing > 1 and n_context > 0 then 'C3_AMBIGUOUS_CONTEXT_ONLY' else 'D_WEAK_EVIDENCE' end tier from ev))
"""
SQL = {
    "entity_universe": WITH + "select * from uni",
    "pending_entities": WITH + "select * from uni where entity_group in ('PER', 'ORG') and length(canonical_entity_key) % 3 = 2",
    "short_long_candidates": WITH + "select * from sl",
    "ambiguous_short_forms": WITH + "select entity_group, short, count(*) n_longs, string_agg(long, '|' order by long) longs from sl group by 1, 2 having count(*) > 1",
    "link_evidence": WITH + "select *, 'LINK-' || entity_group || '-' || lpad(cast(row_number() over (partition by entity_group order by score desc, short, long) as varchar), 4, '0') candidate_id from ev",
    "evidence_tiers": WITH + _TIERED + "select tier, entity_group, count(*) n, round(avg(score), 6) mean_score from td group by 1, 2",
    "tiered_candidates": WITH + _TIERED + "select * from td",
    "tier_statistics": WITH + _TIERED + "select tier, tier_rank, 'ALL' entity_group, count(*) n_candidates, count(distinct (entity_group, short)) n_shorts from td group by 1, 2 union all select tier, tier_rank, entity_group, count(*), count(distinct short) from td group by 1, 2, 3",
    "context_profile": WITH + """select u.canonical_entity_key, article_df n_articles, mention_count n_mentions, (select count(*) from aev where entity = u.canonical_entity_key) n_events, (select count(*) from bsd where entity = u.canonical_entity_key) n_contexts,
  coalesce((select string_agg(o || ' (' || n || ')', '|' order by n desc, o) from (select y.entity o, count(*) n, row_number() over (order by count(*) desc, y.entity) r from ts x join ts y using (article_id) where x.entity = u.canonical_entity_key and y.entity <> x.entity group by 1) where r <= 10), '') top_contexts from uni u""",
    "search_candidates": WITH + "select * from fs",
    "search_status": WITH + "select * from ss",
    "search_summary": WITH + "select entity_group, status, count(*) n_entities, cast(sum(candidate_count) as bigint) n_candidates, cast(sum(mention_count) as bigint) n_mentions, max(candidate_count) most_candidates from ss group by 1, 2",
    "merged_candidates": WITH + """select entity_group, canonical_entity, canonical_entity_key, qid, best_rank, best_language, languages, \"label\", description, \"label\" matched_texts, candidate_index from (
  select *, row_number() over (partition by canonical_entity_key order by best_rank, best_language, qid) candidate_index from (select entity_group, canonical_entity, canonical_entity_key, qid, min(rank) best_rank, min(case language when 'da' then 0 else 1 end) best_language,
    string_agg(language, ',' order by language) languages, any_value(\"label\") \"label\", any_value(description) description from hi group by 1, 2, 3, 4)) where candidate_index <= 10""",
    "probe_entities": WITH + "select canonical_entity_key, rank, language, qid, \"label\" from (select canonical_entity_key from uni order by article_df desc, canonical_entity_key limit 12) left join hi using (canonical_entity_key)",
    "link_payloads": WITH + "select * from pl",
    "link_cost": WITH + """select n_requests, \"read\", cached, written, round(greatest(\"read\" - cached, 0) / 1e6 * 0.25 + cached / 1e6 * 0.025 + written / 1e6 * 2.0, 6) \"cost\" from (
  select count(*) n_requests, cast(sum((length(title) + length(context) + length(entity_keys) + length(coentities)) // 4) as bigint) \"read\", cast(sum(length(title) // 4) as bigint) cached, cast(sum(n_targets * 20) as bigint) written from pl)""",
    "decision_report": WITH + "select resolution_source, decision, confidence, reason, count(*) n_links from lk group by 1, 2, 3, 4",
    "review_examples": WITH + """select * from (select *, case status when 'UNIQUE_TOP' then 1 when 'WEAK_TOP' then 2 when 'TIE' then 3 when 'ZERO' then 4 when 'SINGLE' then 5 else 99 end::bigint review_priority from st)
  order by review_priority, margin desc nulls last, top_score desc nulls last, article_id, canonical_entity_key limit 300""",
    "review_sheet": WITH + f""", sp as ({_SAMPLE}), cs as (select article_id, canonical_entity_key, count(*) n_candidates, string_agg('#' || place || ' ' || qid || ' | ' || \"label\" || ' | score=' || format('{{:.4f}}', cast(round(cast(context_score as decimal(18, 9)), 4) as double)) || case when coalesce(description, '') <> '' then chr(10) || '   ' || description else '' end, chr(10) order by place) candidate_text
    from (select sc.*, kc.\"label\", kc.description, row_number() over (partition by article_id, canonical_entity_key order by context_score desc, sc.candidate_rank, qid) place from sc join kc using (canonical_entity_key, qid)) group by 1, 2)
  select status, sample_rank, article_id, canonical_entity_key, top_qid, candidate_text, n_candidates, va.title, '' review_label, '' correct_qid, '' review_note from sp join cs using (article_id, canonical_entity_key) join va using (article_id)""",
    "metric_quantiles": WITH + ", mv as (" + " union all ".join(f"select '{m}' metric, entity_group, cast({m} as double) v from ev" for m in METRICS) + "), gr as (select m metric, g entity_group from (select unnest(["
    + ", ".join(f"'{m}'" for m in METRICS) + "]) m), (select unnest(['ALL', 'PER', 'ORG']) g)) select gr.metric, gr.entity_group, count(v) n, " + ", ".join(f"coalesce(round({e}, 6), 0) {n}" for n, e in [("min", "min(v)"), ("max", "max(v)"), ("mean", "avg(v)"), *[(f"p{int(q * 100)}", f"quantile_cont(v, {q})") for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]])
    + " from gr left join mv on mv.metric = gr.metric and (gr.entity_group = 'ALL' or gr.entity_group = mv.entity_group) group by 1, 2",
    "knowledge_candidates": WITH + "select * from kc",
    "ancestor_closure": WITH + "select * from cl",
    "type_filter_status": WITH + """select entity_group, canonical_entity_key, policy, n_candidates, \"match\", mismatch, \"unknown\", unchecked, case when status <> 'FOUND' then status when policy = 'UNCHECKED' then 'UNCHECKED_GROUP' when \"match\" = 1 then 'ONE_TYPE_MATCH' when \"match\" > 1 then 'MULTIPLE_TYPE_MATCH'
    when \"unknown\" > 0 then 'NO_MATCH_WITH_UNKNOWN' else 'NO_TYPE_MATCH' end filter_status, case when \"match\" = 1 then mq end one_match_qid, case when \"match\" = 1 then ml end one_match_label from (
  select ss.entity_group, ss.canonical_entity_key, ss.status, case ss.entity_group when 'PER' then 'STRICT' when 'ORG' then 'CONSERVATIVE' when 'LOC' then 'CONSERVATIVE' when 'EVENT' then 'DIAGNOSTIC_ONLY' when 'PROD' then 'CONSERVATIVE' else 'UNCHECKED' end policy,
    count(tf.qid) n_candidates, count(*) filter (type_status = 'MATCH') \"match\", count(*) filter (type_status = 'MISMATCH') mismatch, count(*) filter (type_status = 'UNKNOWN') \"unknown\", count(*) filter (type_status = 'UNCHECKED') unchecked,
    min(tf.qid) filter (type_status = 'MATCH') mq, min(tf.\"label\") filter (type_status = 'MATCH') ml from ss left join tf using (canonical_entity_key) group by 1, 2, 3)""",
    "context_scores": WITH + "select article_id, canonical_entity_key, entity_group, qid, candidate_rank, round(context_score, 6) context_score from sc",
    "context_status": WITH + "select * from st",
    "entity_consistency": WITH + """select canonical_entity_key, top_qid dominant_qid, cases n_cases, round(n / cases, 6) dominant_ratio, w n_winners, n_single, n_unique_top, n_weak_top, n_tie, n_zero from (select *, cast(sum(n) over (partition by canonical_entity_key) as bigint) cases, count(*) over (partition by canonical_entity_key) w, row_number() over (partition by canonical_entity_key order by n desc, f, top_qid) p
  from (select canonical_entity_key, top_qid, count(*) n, min(article_id) f from st group by 1, 2)) join (select canonical_entity_key, count(*) filter (status = 'SINGLE') n_single, count(*) filter (status = 'UNIQUE_TOP') n_unique_top, count(*) filter (status = 'WEAK_TOP') n_weak_top,
  count(*) filter (status = 'TIE') n_tie, count(*) filter (status = 'ZERO') n_zero from st group by 1) using (canonical_entity_key) where p = 1""",
    "link_rows": WITH + "select * from lk",
    "linked_entities": WITH + "select article_id, coalesce(n, 0) n_entities, coalesce(l, 0) n_linked, coalesce(es_, '') entities from va left join (select article_id, count(distinct linked_entity_key) n, count(*) filter (decision = 'LINKED') l, string_agg(distinct linked_entity_key, '|' order by linked_entity_key) es_ from lk group by 1) using (article_id)",
    "link_backjoin": WITH + "select te.article_id, entity_position, te.canonical_entity_key, decision, linked_entity_key from te left join lk using (article_id, canonical_entity_key)",
    "scope_articles": WITH + """, sa as (select article_id, bool_or(is_train_used) is_train_used from ae group by 1), sn as (select *, row_number() over (partition by is_train_used order by cast(article_id as varchar)) nth from sa),
  sk as (select least((select count(*) from sa where is_train_used), greatest(100, 200 - (select count(*) from sa where not is_train_used))) t)
  select article_id, is_train_used from sn, sk where case when is_train_used then nth <= t else nth <= 200 - t end""",
    "review_sample": WITH + _SAMPLE,
}
SQL["type_filter_summary"] = f"select entity_group, policy, filter_status, count(*) n_entities, cast(sum(n_candidates) as bigint) n_candidates, count(one_match_qid) n_one_match from ({SQL['type_filter_status']}) group by 1, 2, 3"
