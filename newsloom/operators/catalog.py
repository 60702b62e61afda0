"""Valid articles, the ids each split uses, category numbers and article masters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import lists
from newsloom.functions.text import blank, strip
from newsloom.operators.quality import duplicated, usable_flags
from newsloom.operators.ranking import global_row_number
from newsloom.runtime import Scratch

UNKNOWN_CATEGORY = "<UNK>"


def article_flags(a: DataFrame) -> DataFrame:
    """``a`` with a flag for each reason an article is left out, and its ``model_text``."""
    title, sub = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("subtitle", F.lit("")))
    text = F.when((title != "") & (sub != ""), F.concat(title, F.lit("\n"), sub)).when(title != "", title).otherwise(sub)
    return a.withColumns(
        {
            "no_id": F.col("article_id").isNull(),
            "repeated_id": duplicated("article_id", ["title", "published_time"]),
            "no_text": (title == "") & (sub == ""),
            "no_time": F.col("published_time").isNull(),
            "list_mismatch": lists.length("ner_clusters") != lists.length("entity_groups"),
            "model_text": F.concat(F.lit("query: "), text),
        }
    )


REASONS = ("no_id", "repeated_id", "no_text", "no_time", "list_mismatch")


def valid_articles(a: DataFrame) -> DataFrame:
    """Articles with a unique id, some text, a time and parallel entity lists; with ``model_text``."""
    flags = article_flags(a.where("article_id is not null"))
    good = ~F.col("repeated_id")
    for r in REASONS[2:]:
        good = good & ~F.col(r)
    return flags.where(good).drop(*REASONS).withColumn("article_id", F.col("article_id").cast("bigint"))


def used_ids(b: DataFrame, h: DataFrame, inview: bool) -> DataFrame:
    """Ids a split refers to: history pairs, current and clicked articles of usable impressions, and candidates if ``inview``."""
    users = h.where("user_id is not null").withColumn("dup", duplicated("user_id", ["article_id_fixed"])).where("not dup and size(article_id_fixed) = size(impression_time_fixed)")
    pairs = users.select(F.inline(F.arrays_zip(F.col("article_id_fixed").alias("a"), F.col("impression_time_fixed").alias("t")))).where("a is not null and t is not null")
    rows = usable_flags(b, False).where("usable")
    clicks = rows.select(F.explode("article_ids_clicked").alias("a"))
    out = pairs.select("a").unionByName(rows.select(F.col("article_id").alias("a"))).unionByName(clicks)
    if inview:
        out = out.unionByName(rows.select(F.explode("article_ids_inview").alias("a")))
    return out.where("a is not null").select(F.col("a").cast("bigint").alias("article_id")).distinct()


def excluded_ids(used: DataFrame, valid: DataFrame, examples: int = 10) -> DataFrame:
    """Used ids that aren't valid articles: how many, the smallest ones, WARNING if there is any."""
    lost = used.join(valid.select("article_id"), "article_id", "left_anti")
    few = lost.orderBy("article_id").limit(examples).agg(lists.text_of(F.sort_array(F.collect_list("article_id"))).alias("examples"))
    n = lost.agg(F.count("*").alias("n_excluded")).withColumn("examples", few.scalar())
    return n.withColumn("status", F.when(F.col("n_excluded") > 0, "WARNING").otherwise("PASS"))


def category_mapping(articles: DataFrame) -> DataFrame:
    """Categories in order, numbered from 1; ``<UNK>`` is 0.  The categories are few: one window orders them."""
    c = strip(F.col("category_str"))
    known = articles.where(~blank(F.col("category_str"))).select(c.alias("category_str")).distinct()
    if not known.where(F.col("category_str") == UNKNOWN_CATEGORY).isEmpty():
        raise ValueError(f"the data holds the category {UNKNOWN_CATEGORY}")
    numbered = known.select("category_str", F.row_number().over(Window.orderBy("category_str")).alias("model_category_id"))
    unknown = known.sparkSession.sql(f"select '{UNKNOWN_CATEGORY}' as category_str, 0 as model_category_id")
    return unknown.unionByName(numbered)


def with_category(articles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Articles with their category number, 0 where it is blank or not in the mapping."""
    m = mapping.where("model_category_id > 0").select(F.col("category_str").alias("known"), "model_category_id")
    return articles.join(m, strip(F.col("category_str")) == F.col("known"), "left").withColumn("model_category_id", F.coalesce("model_category_id", F.lit(0))).drop("known")


def embedding_input(articles: DataFrame, scratch: Scratch) -> DataFrame:
    """``embedding_row`` from 0 in the order of article_id, with the text to embed."""
    return global_row_number(articles.select("article_id", "model_text"), ["article_id"], "embedding_row", scratch).select("embedding_row", "article_id", "model_text")


def article_master(ids: DataFrame, articles: DataFrame, rows: DataFrame, events: DataFrame) -> DataFrame:
    """One row an article: embedding row, category, event, time and text."""
    return (
        ids.join(articles.select("article_id", "model_category_id", "published_time", "model_text"), "article_id", "left")
        .join(rows.select("article_id", "embedding_row"), "article_id", "left")
        .join(events.select("article_id", "event_id"), "article_id", "left")
        .select("article_id", "embedding_row", F.col("model_category_id").cast("int"), "event_id", "published_time", "model_text")
    )


def master_defects(master: DataFrame, n_embeddings: int) -> DataFrame:
    """Counts that must all be 0."""
    return master.agg(
        F.count_if(F.col("embedding_row").isNull() | F.col("event_id").isNull() | F.col("published_time").isNull()).alias("null_rows"),
        (F.count("*") - F.count_distinct("article_id")).alias("repeated_ids"),
        F.count_if(blank(F.col("model_text"))).alias("blank_texts"),
        F.count_if((F.col("embedding_row") < 0) | (F.col("embedding_row") >= n_embeddings)).alias("rows_out_of_range"),
    )


def require_master(master: DataFrame, n_embeddings: int, name: str) -> DataFrame:
    """The master itself, if nothing is wrong with it."""
    wrong = {k: n for k, n in master_defects(master, n_embeddings).first().asDict().items() if n}
    if wrong:
        raise ValueError(f"{name}: {wrong}")
    return master
