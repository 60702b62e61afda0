"""Hits of a knowledge-base search, what is asked about them, and how decisions on them are kept.

Hits are a table, fetched beforehand: ``entity_group, canonical_entity,
canonical_entity_key, language, rank, qid, label, description, match_text``.
Empty tables give no rows; an entity without hits keeps its row in
``search_status``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import truncated

#: Languages that are searched, the first one first.
LANGUAGES = ("da", "en")
#: Prices of a million tokens: read, read from a cache, written.
TOKEN_PRICES = {"input": 0.25, "cached": 0.025, "output": 2.0}
#: Words in the names of a candidate's classes that speak for an organisation, and for a place.
ORGANISATION_WORDS = ("organization", "organisation", "company", "business", "club", "team", "association", "agency", "institution", "government", "corporation", "enterprise", "political party")
PLACE_WORDS = ("geographic", "geographical", "city", "country", "municipality", "village", "town", "district", "region", "island", "river", "lake", "sea", "territorial", "location", "place")
KEY = ("entity_group", "canonical_entity", "canonical_entity_key")


def language_index(c: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """Place of a language, 999 for another one."""
    at = F.array_position(F.array(*[F.lit(x) for x in languages]), c)
    return F.when(at > 0, at - 1).otherwise(F.lit(999))


def resolve_columns(columns: list[str], wanted: dict[str, tuple[str, ...]], given: dict[str, str] | None = None, optional: tuple[str, ...] = ()) -> dict[str, str | None]:
    """The column that stands for each wanted one: the given one, else the first of its names that is there, whatever its letter case.

    A given column that isn't there, or a wanted one without any, is an error; an optional one is None then.
    """
    there, out = {c.casefold(): c for c in columns}, {}
    for name, names in wanted.items():
        own = (given or {}).get(name)
        if own is not None and own not in columns:
            raise ValueError(f"{own}, given for {name}, isn't among {', '.join(columns)}")
        out[name] = own or next((there[x.casefold()] for x in names if x.casefold() in there), None)
        if out[name] is None and name not in optional:
            raise ValueError(f"none of {', '.join(names)}, looked for as {name}, is among {', '.join(columns)}")
    return out


def soft_type(group: Column, instance_of: Column, class_labels: Column) -> Column:
    """What the names of a candidate's classes and their parents say about its type; a hint that drops nothing.

    ``instance_of``: ids of its classes; ``class_labels``: names of these, their parents and its own parents.
    """
    text = F.lower(F.array_join(class_labels, " | "))
    says = lambda words: F.when(text.rlike("|".join(words)), "TYPE_MATCH").otherwise("TYPE_UNKNOWN")
    nothing = (F.coalesce(F.size(instance_of), F.lit(0)) == 0) & (F.coalesce(F.size(class_labels), F.lit(0)) == 0)
    person = F.when(F.array_contains(instance_of, "Q5"), "TYPE_MATCH").otherwise("TYPE_MISMATCH")
    g = F.upper(group)
    return F.when(nothing, "TYPE_UNKNOWN").when(g == "PER", person).when(g == "ORG", says(ORGANISATION_WORDS)).when(g == "LOC", says(PLACE_WORDS)).otherwise("TYPE_UNCHECKED")


def hits_of(cache: DataFrame) -> DataFrame:
    """Hits from cached searches (``entity_group, canonical_entity, canonical_entity_key, searches``): one row a result of each language, in the order it was given.

    ``searches``: array of (language, results), ``results``: array of (id, label, description, match text).
    """
    each = cache.select(*KEY, F.explode("searches").alias("s")).select(*KEY, F.col("s.language").alias("language"), F.posexplode("s.results").alias("i", "r"))
    rows = each.select(*KEY, "language", (F.col("i") + 1).cast("bigint").alias("rank"), F.col("r.id").alias("qid"), F.col("r.label").alias("label"), F.col("r.description").alias("description"), F.col("r.match.text").alias("match_text"))
    return rows.where(F.col("qid").startswith("Q"))


def first_seen(hits: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Candidates in the order in which languages, then ranks, bring them; an id seen before is dropped."""
    seen = F.struct(language_index(F.col("language"), languages).alias("l"), F.col("rank").alias("r"))
    once = hits.withColumn("seen", seen).withColumn("nth", F.row_number().over(Window.partitionBy("canonical_entity_key", "qid").orderBy("seen", "label"))).where("nth = 1")
    w = Window.partitionBy("canonical_entity_key").orderBy("seen", "qid")  # a search gives few hits
    return once.withColumn("candidate_rank", F.row_number().over(w).cast("bigint")).select(*KEY, "candidate_rank", "qid", "label", "description", F.col("language").alias("search_language"), F.col("rank").alias("search_rank"), "match_text")


def merged(hits: DataFrame, languages: tuple[str, ...] = LANGUAGES, most: int = 10) -> DataFrame:
    """Candidates of all languages together: by best rank, then best language, then id; the first ``most`` are the feature.

    ``search_ranks`` holds the best rank of each language, ``matched_texts`` the first two texts that matched.
    """
    index = language_index(F.col("language"), languages)
    per = hits.groupBy(*KEY, "qid").agg(
        F.min("rank").alias("best_rank"), F.min(index).alias("best_language"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.struct(index.alias("l"), "language"))), lambda x: x["language"]), ",").alias("languages"),
        F.min_by("label", F.struct(index, "rank")).alias("label"), F.min_by("description", F.struct(index, "rank")).alias("description"),
        F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_set(F.struct(index.alias("l"), "rank", "match_text"))), lambda x: x["match_text"])), 1, 2).alias("matched_texts"),
    )
    w = Window.partitionBy("canonical_entity_key").orderBy("best_rank", "best_language", "qid")
    return per.withColumn("candidate_index", F.row_number().over(w).cast("bigint")).where(F.col("candidate_index") <= most)


def search_status(universe: DataFrame, candidates: DataFrame, failed: DataFrame) -> DataFrame:
    """Every searched entity with FOUND, NO_CANDIDATE or ERROR (``failed``: canonical_entity_key) and its number of candidates."""
    n = candidates.groupBy("canonical_entity_key").agg(F.count("*").alias("candidate_count"))
    bad = failed.select("canonical_entity_key").distinct().withColumn("bad", F.lit(True))
    out = universe.join(n, "canonical_entity_key", "left").join(bad, "canonical_entity_key", "left")
    status = F.when(F.col("bad"), "ERROR").when(F.col("candidate_count") > 0, "FOUND").otherwise("NO_CANDIDATE")
    return out.withColumns({"status": status, "candidate_count": F.when(F.col("bad"), 0).otherwise(F.coalesce("candidate_count", F.lit(0)))}).drop("bad")


def status_summary(status: DataFrame) -> DataFrame:
    """Entities, articles and candidates by group and status."""
    return status.groupBy("entity_group", "status").agg(F.count("*").alias("n_entities"), F.sum("candidate_count").alias("n_candidates"), F.sum("mention_count").alias("n_mentions"), F.max("candidate_count").alias("most_candidates"))


def entity_pairs(mentions: DataFrame) -> DataFrame:
    """Distinct (article, key) with the key's group and name."""
    return mentions.where("article_id is not null").select("article_id", "entity_group", "canonical_entity", "canonical_entity_key").dropDuplicates(["article_id", "canonical_entity_key"])


def context_map(articles: DataFrame, columns: list[str], chars: int | None = None) -> DataFrame:
    """``article_id, title, context``: the texts that aren't blank, a blank line between them; cut to ``chars`` only where that is given.

    An article that stands in several rows keeps its first one by text.
    """
    parts = F.filter(F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in columns]), lambda x: x != "")
    text = F.array_join(parts, "\n\n")
    rows = articles.where("article_id is not null").select("article_id", F.trim(F.coalesce("title", F.lit(""))).alias("title"), (truncated(text, chars) if chars else text).alias("context"))
    return rows.groupBy("article_id").agg(F.min(F.struct("title", "context")).alias("c")).select("article_id", "c.title", "c.context")


def payload_chunks(pairs: DataFrame, contexts: DataFrame, size: int = 8, most: int = 30) -> DataFrame:
    """What is asked at once: an article's entities in the order of their keys, ``size`` a chunk, each with the first ``most`` other entities of the article."""
    w = Window.partitionBy("article_id").orderBy("canonical_entity_key")  # an article's entities are one row's lists
    placed = pairs.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))
    each = F.struct("canonical_entity_key", F.concat("canonical_entity", F.lit(" ("), "entity_group", F.lit(")")).alias("shown"), "chunk")
    own = placed.groupBy("article_id").agg(F.sort_array(F.collect_list(each)).alias("all"))
    chunks = own.select("article_id", "all", F.explode(F.array_distinct(F.col("all.chunk"))).alias("chunk"))
    targets, others = F.filter("all", lambda x: x["chunk"] == F.col("chunk")), F.filter("all", lambda x: x["chunk"] != F.col("chunk"))
    out = chunks.select("article_id", "chunk", targets["canonical_entity_key"].alias("entity_keys"), F.slice(others["shown"], 1, most).alias("coentities")).join(contexts, "article_id", "left")
    return out.select("article_id", "chunk", F.size("entity_keys").cast("bigint").alias("n_targets"), F.array_join("entity_keys", "|").alias("entity_keys"), F.array_join("coentities", "|").alias("coentities"), "title", "context")


def token_cost(read: Column, cached: Column, written: Column) -> Column:
    """Price of a request; tokens read from the cache are part of those read."""
    return F.greatest(read - cached, F.lit(0)) / 1e6 * TOKEN_PRICES["input"] + cached / 1e6 * TOKEN_PRICES["cached"] + written / 1e6 * TOKEN_PRICES["output"]


def decided(payloads: DataFrame, decide: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """What ``decide`` answers: it is given the payloads of an Arrow batch, as dicts, and returns rows of ``schema``; it runs on the workers.

    A batch is as large as ``spark.sql.execution.arrow.maxRecordsPerBatch``; an empty answer gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(",")]
        for pdf in batches:
            answers = decide(pdf.to_dict("records"))
            if answers:
                yield pd.DataFrame(answers, columns=names)

    return payloads.mapInPandas(run, schema)


def probed(names: DataFrame, hits: DataFrame) -> DataFrame:
    """The given entities (``canonical_entity_key``) with their hits; one without any has a row of nulls."""
    found = hits.groupBy("canonical_entity_key").agg(F.sort_array(F.collect_list(F.struct("rank", "language", "qid", "label"))).alias("h"))
    return names.select("canonical_entity_key").distinct().join(found, "canonical_entity_key", "left").select("canonical_entity_key", F.explode_outer("h").alias("h")).select("canonical_entity_key", "h.*")


def judged(pairs: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """``pairs`` (article_id, canonical_entity_key) with the decision on each and the ``issue`` that keeps it from counting, or null.

    Decisions on other keys are ignored.  ``decisions``: article_id, canonical_entity_key, decision, selected_qid, confidence, reason.
    """
    key = ["article_id", "canonical_entity_key"]
    one = decisions.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct("decision", "selected_qid", "confidence", "reason")).alias("d")).select(*key, "copies", "d.*")
    offered = candidates.select("canonical_entity_key", F.col("qid").alias("selected_qid")).distinct().withColumn("offered", F.lit(True))
    j = pairs.join(one, key, "left").join(offered, ["canonical_entity_key", "selected_qid"], "left")
    chosen = F.coalesce("selected_qid", F.lit("")) != ""
    issue = (
        F.when(F.col("copies").isNull(), "missing decision")
        .when(F.col("copies") > 1, "repeated decision")
        .when((F.col("decision") == "LINKED") & F.col("offered").isNull(), "id that wasn't offered")
        .when((F.col("decision") != "LINKED") & chosen, "id without a link")
    )
    return j.withColumn("issue", issue).drop("copies", "offered")


def resolved(pairs: DataFrame, candidates: DataFrame, decisions: DataFrame, repairs: DataFrame) -> DataFrame:
    """The link of each distinct (article, key), and how it came about.

    ``resolution_source``: NO_CANDIDATE, DECISION, REPAIR (the decision had an
    issue, the second one on it hadn't) or FALLBACK (both had: UNLINKED, LOW).
    A link turns the key into ``WD::<id>``, else the key stays.
    """
    key = ["article_id", "canonical_entity_key"]
    counted = candidates.groupBy("canonical_entity_key").agg(F.count_distinct("qid").alias("candidate_count"))
    asked = pairs.select(*key).distinct().join(counted, "canonical_entity_key", "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    fields = ("decision", "selected_qid", "confidence", "reason", "issue")
    first = judged(asked.where("candidate_count > 0").select(*key), candidates, decisions)
    again = judged(first.where("issue is not null").select(*key), candidates, repairs).select(*key, *[F.col(c).alias(f"r_{c}") for c in fields])
    j = asked.join(first, key, "left").join(again, key, "left")
    source = F.when(F.col("candidate_count") == 0, "NO_CANDIDATE").when(F.col("issue").isNull(), "DECISION").when(F.col("r_issue").isNull(), "REPAIR").otherwise("FALLBACK")
    j = j.withColumn("resolution_source", source)
    pick = lambda c, none, back: F.when(source == "DECISION", F.col(c)).when(source == "REPAIR", F.col(f"r_{c}")).when(source == "FALLBACK", back).otherwise(none)
    unlinked = F.lit("UNLINKED")
    out = j.select(*key, "candidate_count", pick("decision", unlinked, unlinked).alias("decision"), pick("selected_qid", F.lit(None), F.lit(None)).alias("q"), pick("confidence", F.lit("HIGH"), F.lit("LOW")).alias("confidence"), pick("reason", F.lit("no candidate"), F.col("issue")).alias("reason"), "resolution_source")
    qid = F.when(F.col("decision") == "LINKED", F.col("q"))
    return out.withColumns({"selected_qid": qid, "linked_entity_key": F.coalesce(F.concat(F.lit("WD::"), qid), "canonical_entity_key")}).drop("q")


def review_text(scores: DataFrame, case: list[str]) -> DataFrame:
    """Per case its candidates as text, best first: place, id, label and score, the description below."""
    w = Window.partitionBy(*case).orderBy(F.desc("context_score"), "candidate_rank", "qid")  # a case has few candidates
    placed = scores.withColumn("place", F.row_number().over(w))
    line = F.concat(F.format_string("#%d %s | %s | score=%.4f", "place", "qid", F.coalesce("label", F.lit("")), F.round(F.col("context_score").cast("decimal(18,9)"), 4).cast("double")), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n   "), "description")).otherwise(""))
    return placed.groupBy(*case).agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", line.alias("t"))))["t"], "\n").alias("candidate_text"), F.count("*").alias("n_candidates"))


def review_order(status: DataFrame, most: int = 300) -> DataFrame:
    """Cases as they are reviewed: clear winners among several first, then weak ones, ties, zeros, single candidates; by margin and score.  The limit is the feature."""
    order = ["UNIQUE_TOP", "WEAK_TOP", "TIE", "ZERO", "SINGLE"]
    priority = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("status"))
    placed = status.withColumn("review_priority", F.when(priority > 0, priority).otherwise(99).cast("bigint"))
    return placed.orderBy("review_priority", F.desc_nulls_last("margin"), F.desc_nulls_last("top_score"), "article_id", "canonical_entity_key").limit(most)
