"""Linking entities to each other and to an outside knowledge base: candidates, evidence, filters, scores, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import word_tokens
from newsloom.operators.entities import link_acronym
from newsloom.operators.graph import ancestors
from newsloom.operators.ranking import grouped_row_number
from newsloom.runtime import Scratch

#: Weights of the evidence score (same article, same event, context overlap, competing long forms).
EVIDENCE = {"article": 3.0, "event": 1.5, "context": 5.0, "competing": 2.0}
#: Weights of the context score and of its description part, and the margin of a clear winner.
CONTEXT = {"exact_label": 1.0, "search_exact": 0.5, "label_overlap": 1.5, "description": 1.0}
DESCRIPTION_RATIO, DESCRIPTION_COUNT, DESCRIPTION_CAP = 0.7, 0.3, 5
CLEAR_MARGIN, TIE = 0.15, 1e-12
#: Words left out of context tokens.
STOP_WORDS = (
    "og", "i", "på", "af", "for", "til", "med", "en", "et", "den", "det", "de", "der", "som", "fra", "er", "var", "har", "om", "at", "ved", "eller", "ikke", "sin", "sit", "sine",
    "the", "a", "an", "and", "of", "in", "on", "to", "with", "by", "from", "is", "was", "are", "were", "as", "or", "that", "this", "his", "her", "their",
)
#: Classes that each group's candidates must descend from, and how a mismatch counts.
TYPE_ROOTS = {
    "PER": ("Q5",),
    "ORG": ("Q43229",),
    "LOC": ("Q2221906", "Q618123", "Q56061", "Q486972", "Q6256"),
    "EVENT": ("Q1190554",),
    "PROD": ("Q2424752",),
}
TYPE_POLICIES = {"PER": "STRICT", "ORG": "CONSERVATIVE", "LOC": "CONSERVATIVE", "EVENT": "DIAGNOSTIC_ONLY", "PROD": "CONSERVATIVE", "MISC": "UNCHECKED"}


def short_long_candidates(vocabulary: DataFrame) -> DataFrame:
    """``entity_group, short, long``: surname of a person, acronym of an organisation, where the short one is in the vocabulary.

    ``vocabulary``: distinct ``entity_group, entity``.
    """
    per = vocabulary.where("entity_group = 'PER' and entity like '% %'").select("entity_group", F.element_at(F.split("entity", " "), -1).alias("short"), F.col("entity").alias("long"))
    org = vocabulary.where("entity_group = 'ORG'").select("entity_group", link_acronym(F.col("entity")).alias("short"), F.col("entity").alias("long")).where("short is not null")
    known = vocabulary.select("entity_group", F.col("entity").alias("short"))
    return per.unionByName(org).join(known, ["entity_group", "short"], "left_semi")


def evidence(pairs: DataFrame, sets: DataFrame, article_events: DataFrame) -> DataFrame:
    """Pairs with what ties them: articles and events in common, overlap of the entities beside them, competing long forms, score.

    ``sets``: distinct ``article_id, entity`` (keys); only the articles of entities in question are expanded.
    """
    key = lambda c: F.concat("entity_group", F.lit("::"), c)
    p = pairs.withColumns({"short_key": key(F.col("short")), "long_key": key(F.col("long"))}).withColumn("competing", F.count("*").over(Window.partitionBy("short_key")))
    asked = p.select(F.col("short_key").alias("entity")).unionByName(p.select(F.col("long_key").alias("entity"))).distinct()
    own = sets.join(asked, "entity", "left_semi")
    by_article = p.join(own.select(F.col("entity").alias("short_key"), "article_id"), "short_key").join(own.select(F.col("entity").alias("long_key"), "article_id"), ["long_key", "article_id"]).groupBy("short_key", "long_key").agg(F.count("*").alias("n_articles"))
    ev = own.join(article_events.where("event_id is not null and event_id <> -1 and article_id is not null").select(F.col("article_id").cast("bigint"), "event_id").distinct(), "article_id").select("entity", "event_id").distinct()
    by_event = p.join(ev.withColumnRenamed("entity", "short_key"), "short_key").join(ev.withColumnRenamed("entity", "long_key"), ["long_key", "event_id"]).groupBy("short_key", "long_key").agg(F.count("*").alias("n_events"))
    beside = own.join(sets.select("article_id", F.col("entity").alias("other")), "article_id").where("entity <> other").select("entity", "other").distinct()
    size = beside.groupBy("entity").agg(F.count("*").alias("n"))
    shared = p.join(beside.withColumnRenamed("entity", "short_key"), "short_key").join(beside.withColumnRenamed("entity", "long_key"), ["long_key", "other"]).groupBy("short_key", "long_key").agg(F.count("*").alias("n_context"))
    out = p
    for one in (by_article, by_event, shared):
        out = out.join(one, ["short_key", "long_key"], "left")
    articles, events = own.groupBy("entity").agg(F.count("*").alias("n")), ev.groupBy("entity").agg(F.count("*").alias("n"))
    for side in ("short", "long"):
        for what, n in (("size", size), ("df", articles), ("events", events)):
            out = out.join(n.select(F.col("entity").alias(f"{side}_key"), F.col("n").alias(f"{side}_{what}")), f"{side}_key", "left")
    out = out.fillna(0, ["n_articles", "n_events", "n_context", *[f"{x}_{y}" for x in ("short", "long") for y in ("size", "df", "events")]])
    union = F.col("short_size") + F.col("long_size") - F.col("n_context")
    jaccard = F.when(union > 0, F.col("n_context") / union).otherwise(0.0)
    score = EVIDENCE["article"] * F.col("n_articles") + EVIDENCE["event"] * F.col("n_events") + EVIDENCE["context"] * jaccard - EVIDENCE["competing"] * F.greatest(F.col("competing") - 1, F.lit(0))
    return out.select("entity_group", "short", "long", "competing", "short_df", "long_df", "short_events", "long_events", "n_articles", "n_events", "n_context", F.round(jaccard, 6).alias("jaccard"), F.round(score, 6).alias("score"))


def context_profile(m: DataFrame, article_events: DataFrame, top: int = 10) -> DataFrame:
    """Per entity (``canonical_entity_key``) of train: articles, mentions, events, other entities beside it and the most frequent of these; the limit is the feature."""
    t = m.where("is_train_used")
    base = t.groupBy("canonical_entity_key").agg(F.count_distinct("article_id").alias("n_articles"), F.count("*").alias("n_mentions"))
    sets = t.select("article_id", F.col("canonical_entity_key").alias("entity")).distinct()
    known = article_events.where("event_id is not null and event_id <> -1 and article_id is not null").select(F.col("article_id").cast("bigint"), "event_id").distinct()
    events = sets.join(known, "article_id").groupBy("entity").agg(F.count_distinct("event_id").alias("n_events"))
    beside = sets.join(sets.withColumnRenamed("entity", "other"), "article_id").where("entity <> other").groupBy("entity", "other").agg(F.count("*").alias("n"))
    w = Window.partitionBy("entity").orderBy(F.desc("n"), "other")
    few = beside.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    shown = few.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", F.format_string("%s (%d)", "other", "n").alias("t"))))["t"], "|").alias("top_contexts"))
    many = beside.groupBy("entity").agg(F.count("*").alias("n_contexts"))
    out = base
    for one in (events, many, shown):
        out = out.join(one.withColumnRenamed("entity", "canonical_entity_key"), "canonical_entity_key", "left")
    return out.fillna(0, ["n_events", "n_contexts"]).fillna("", ["top_contexts"])


def tiered(e: DataFrame) -> DataFrame:
    """Candidates with tier and rank, the share of either side's articles that hold both, and whether they are reviewed first or are ambiguous.

    ``review_order`` gives the order in which they are reviewed.
    """
    t = tier(e)
    rank = F.array_position(F.array(*[F.lit(x) for x in TIERS]), F.col("tier")).cast("bigint")
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("n_articles") / F.col(n), 6)).otherwise(0.0)
    return t.withColumns(
        {
            "tier_rank": rank, "is_unique_short": F.col("competing") == 1, "long_coverage": share("long_df"), "short_coverage": share("short_df"),
            "is_priority": F.col("tier").isin("A1_UNIQUE_SAME_ARTICLE", "A2_UNIQUE_SHARED_EVENT"), "is_ambiguous": F.col("tier").startswith("C"),
        }
    )


#: Tiers in the order of review.
TIERS = ("A1_UNIQUE_SAME_ARTICLE", "A2_UNIQUE_SHARED_EVENT", "B_UNIQUE_CONTEXT_ONLY", "C1_AMBIGUOUS_SAME_ARTICLE", "C2_AMBIGUOUS_SHARED_EVENT", "C3_AMBIGUOUS_CONTEXT_ONLY", "D_WEAK_EVIDENCE")


def review_order() -> list[Column]:
    return [F.col("tier_rank"), *[F.desc(c) for c in ("n_articles", "n_events", "jaccard", "score")], *[F.col(c) for c in ("entity_group", "short", "long")]]


def tier_statistics(t: DataFrame) -> DataFrame:
    """Candidates and short forms of each tier, of all and by group."""
    out = t.groupingSets([[F.col("tier"), F.col("tier_rank")], [F.col("tier"), F.col("tier_rank"), F.col("entity_group")]], F.col("tier"), F.col("tier_rank"), F.col("entity_group")).agg(
        F.count("*").alias("n_candidates"), F.count_distinct(F.struct("entity_group", "short")).alias("n_shorts")
    )
    return out.withColumn("entity_group", F.coalesce("entity_group", F.lit("ALL")))


def numbered_candidates(e: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidates with an id LINK-<group>-0001 by score within their group."""
    n = grouped_row_number(e, ["entity_group"], [F.desc("score"), "short", "long"], "__n", scratch)
    return n.withColumn("candidate_id", F.format_string("LINK-%s-%04d", "entity_group", "__n")).drop("__n")


def tier(e: DataFrame) -> DataFrame:
    """Order in which candidates are reviewed: unique short forms first, and the nearest evidence first."""
    alone = F.col("competing") == 1
    label = (
        F.when(alone & (F.col("n_articles") > 0), "A1_UNIQUE_SAME_ARTICLE")
        .when(alone & (F.col("n_events") > 0), "A2_UNIQUE_SHARED_EVENT")
        .when(alone & (F.col("n_context") > 0), "B_UNIQUE_CONTEXT_ONLY")
        .when(~alone & (F.col("n_articles") > 0), "C1_AMBIGUOUS_SAME_ARTICLE")
        .when(~alone & (F.col("n_events") > 0), "C2_AMBIGUOUS_SHARED_EVENT")
        .when(~alone & (F.col("n_context") > 0), "C3_AMBIGUOUS_CONTEXT_ONLY")
        .otherwise("D_WEAK_EVIDENCE")
    )
    return e.withColumn("tier", label)


def metric_quantiles(e: DataFrame, metrics: list[str], groups: tuple[str, ...] = ("PER", "ORG"), quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, range, mean and quantiles of each metric, over all candidates and by group, in one grouping-sets pass; zeros where there is no candidate."""
    long = e.unpivot(["entity_group"], metrics, "metric", "value")
    q = [F.round(F.percentile("value", F.lit(x)), 6).alias(f"p{int(x * 100)}") for x in quantiles]
    agg = [F.count("*").alias("n"), F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"), F.round(F.avg("value"), 6).alias("mean"), *q]
    out = long.groupingSets([[F.col("metric")], [F.col("metric"), F.col("entity_group")]], F.col("metric"), F.col("entity_group")).agg(*agg).withColumn("entity_group", F.coalesce("entity_group", F.lit("ALL")))
    grid = e.sparkSession.createDataFrame([(m, g) for m in metrics for g in ("ALL", *groups)], "metric string, entity_group string")
    return grid.join(out, ["metric", "entity_group"], "left").fillna(0).fillna(0.0)


def universe(m: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Train entities with their articles and mentions."""
    t = m.where("is_train_used")
    if groups:
        t = t.where(F.col("entity_group").isin(groups))
    return t.groupBy("entity_group", "canonical_entity", "canonical_entity_key").agg(F.count_distinct("article_id").alias("article_df"), F.count("*").alias("mention_count"))


def pending(wanted: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Entities still to be searched: those without a final status (an ERROR is tried again), the most frequent first."""
    open_ = wanted.join(done.where(F.col("status").isin("FOUND", "NO_CANDIDATE")).select("canonical_entity_key"), "canonical_entity_key", "left_anti")
    return open_ if limit is None else open_.orderBy(F.desc("article_df"), F.desc("mention_count"), "canonical_entity_key").limit(limit)


def class_filter(candidates: DataFrame, instance_of: DataFrame, subclass_of: DataFrame, scratch: Scratch, depth: int = 8) -> DataFrame:
    """Candidates with ``type_status``: UNCHECKED, UNKNOWN (no class), MATCH or MISMATCH with the group's roots.

    ``candidates``: entity_group, key, qid; ``instance_of``: qid, class; ``subclass_of``: child, parent.
    """
    roots = candidates.sparkSession.createDataFrame([(g, r) for g, rs in TYPE_ROOTS.items() for r in rs], "entity_group string, ancestor string")
    above = ancestors(subclass_of, instance_of.select(F.col("class").alias("node")).distinct(), scratch, depth)
    reach = instance_of.join(above, instance_of["class"] == above["node"]).select("qid", "ancestor").distinct().join(F.broadcast(roots), "ancestor").select("entity_group", "qid").distinct().withColumn("match", F.lit(True))
    typed = instance_of.select("qid").distinct().withColumn("typed", F.lit(True))
    status = F.when(~F.col("entity_group").isin(*TYPE_ROOTS), "UNCHECKED").when(F.col("typed").isNull(), "UNKNOWN").when(F.col("match"), "MATCH").otherwise("MISMATCH")
    return candidates.join(typed, "qid", "left").join(reach, ["entity_group", "qid"], "left").withColumn("type_status", status).drop("typed", "match")


def filter_summary(typed: DataFrame, status: DataFrame) -> DataFrame:
    """Per searched entity how many candidates are of its type, what that says, and the only one that is, if it is alone.

    ``status``: the searched entities with their status; what wasn't found keeps it.
    """
    match = F.col("type_status") == "MATCH"
    n = typed.groupBy("canonical_entity_key").agg(F.count("*").alias("n_candidates"), *[F.count_if(F.col("type_status") == s).alias(s.lower()) for s in ("MATCH", "MISMATCH", "UNKNOWN", "UNCHECKED")], F.min(F.when(match, F.struct("qid", "label"))).alias("m"))
    counts = ("n_candidates", "match", "mismatch", "unknown", "unchecked")
    out = status.select("entity_group", "canonical_entity_key", "status").join(n, "canonical_entity_key", "left").fillna(0, list(counts))
    policy = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_POLICIES.items() for x in kv]), F.col("entity_group")), F.lit("UNCHECKED"))
    label = (
        F.when(F.col("status") != "FOUND", F.col("status")).when(policy == "UNCHECKED", "UNCHECKED_GROUP").when(F.col("match") == 1, "ONE_TYPE_MATCH")
        .when(F.col("match") > 1, "MULTIPLE_TYPE_MATCH").when(F.col("unknown") > 0, "NO_MATCH_WITH_UNKNOWN").otherwise("NO_TYPE_MATCH")
    )
    one = F.when(F.col("match") == 1, F.col("m"))
    return out.select("entity_group", "canonical_entity_key", policy.alias("policy"), *counts, label.alias("filter_status"), one["qid"].alias("one_match_qid"), one["label"].alias("one_match_label"))


def context_tokens(c: Column) -> Column:
    """Distinct tokens of two letters or more that aren't stop words, of an already normalised text."""
    return F.array_distinct(F.filter(word_tokens(c), lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS)))


def context_scores(cases: DataFrame) -> DataFrame:
    """Score of each case (mention with a candidate).

    ``cases``: ``surface, label, match_text, label_tokens, description_tokens, article_tokens`` (normalised) and keys, which are kept.
    """
    ratio = lambda a: F.size(F.array_intersect(a, "article_tokens")) / F.greatest(F.size(a), F.lit(1))
    count = F.size(F.array_intersect("description_tokens", "article_tokens"))
    described = DESCRIPTION_RATIO * ratio("description_tokens") + DESCRIPTION_COUNT * F.least(count, F.lit(DESCRIPTION_CAP)) / DESCRIPTION_CAP
    raw = (
        CONTEXT["exact_label"] * (F.col("surface") == F.col("label")).cast("int")
        + CONTEXT["search_exact"] * F.coalesce((F.col("match_text") != "") & (F.col("match_text") == F.col("surface")), F.lit(False)).cast("int")
        + CONTEXT["label_overlap"] * ratio("label_tokens")
        + CONTEXT["description"] * described
    )
    return cases.withColumn("context_score", F.round(raw / sum(CONTEXT.values()), 9))


def context_status(scores: DataFrame, case: list[str]) -> DataFrame:
    """Per case: best and second candidate, margin, ties and how clear the winner is."""
    w = Window.partitionBy(*case).orderBy(F.desc("context_score"), "candidate_rank", "qid")
    best = F.max("context_score").over(Window.partitionBy(*case))
    ranked = scores.withColumns({"place": F.row_number().over(w), "second": F.lead("context_score").over(w), "n": F.count("*").over(Window.partitionBy(*case)), "ties": F.sum((best - F.col("context_score") <= TIE).cast("int")).over(Window.partitionBy(*case))})
    margin = F.col("context_score") - F.coalesce("second", F.lit(0.0))
    label = F.when(F.col("n") == 1, "SINGLE").when(F.col("context_score") <= TIE, "ZERO").when(F.col("ties") > 1, "TIE").when(margin >= CLEAR_MARGIN, "UNIQUE_TOP").otherwise("WEAK_TOP")
    return ranked.where("place = 1").select(*case, F.col("qid").alias("top_qid"), F.round("context_score", 6).alias("top_score"), F.round("second", 6).alias("second_score"), F.round(margin, 6).alias("margin"), F.col("n").alias("n_candidates"), "ties", label.alias("status"))


def consistency(status: DataFrame, entity: str) -> DataFrame:
    """Per entity: its most frequent winner (first seen among equals), that one's share, and its cases by status."""
    n = status.groupBy(entity, "top_qid").agg(F.count("*").alias("n"), F.min("article_id").alias("first"))
    best = n.groupBy(entity).agg(F.sum("n").alias("n_cases"), F.max_by(F.struct("top_qid", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("b"), F.count("*").alias("n_winners"))
    kinds = status.groupBy(entity).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("SINGLE", "UNIQUE_TOP", "WEAK_TOP", "TIE", "ZERO")])
    return best.join(kinds, entity).select(entity, F.col("b.top_qid").alias("dominant_qid"), "n_cases", F.round(F.col("b.n") / F.col("n_cases"), 6).alias("dominant_ratio"), "n_winners", *[c for c in kinds.columns if c != entity])


def scope_ids(ids: DataFrame, limit: int | None, scratch: Scratch) -> DataFrame:
    """Articles to process: all without a limit; else half train, half other, what one half lacks goes to the other; ids as text order them."""
    if limit is None:
        return ids
    n = {r["is_train_used"]: r["n"] for r in ids.groupBy("is_train_used").agg(F.count("*").alias("n")).collect()}
    train = min(n.get(True, 0), max((limit + 1) // 2, limit - n.get(False, 0)))
    other = min(n.get(False, 0), limit - train)
    placed = grouped_row_number(ids, ["is_train_used"], [F.col("article_id").cast("string")], "nth", scratch)
    return placed.where((F.col("is_train_used") & (F.col("nth") <= train)) | (~F.col("is_train_used") & (F.col("nth") <= other))).drop("nth")
