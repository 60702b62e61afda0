"""Queries of problem 1: titles and mentions in other characters than they seem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.names import unique_articles
from newsloom.llm.plainform import plain_forms
from newsloom.runtime import Scratch


def named_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles (item_pos -1) and mentions of all articles."""
    a = unique_articles(spark, d, "title", "ner_clusters")
    titles = a.select("article_id", F.lit("title").alias("field_name"), F.lit(-1).cast("bigint").alias("item_pos"), F.col("title").alias("text"))
    mentions = a.select("article_id", F.lit("ner_clusters").alias("field_name"), F.posexplode("ner_clusters").alias("item_pos", "text"))
    return titles.unionByName(mentions.withColumn("item_pos", F.col("item_pos").cast("bigint"))).where("text is not null")


def changed_texts(spark: SparkSession, d: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All titles and mentions; and of the texts that aren't in their plain form, that form."""
    texts = scratch.keep(named_texts(spark, d))
    with Scratch(spark, "forms", scratch.merge) as own:
        return texts, scratch.keep(plain_forms(texts, own).where("plain <> text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Titles and mentions whose characters aren't those of their plain form."""
    texts, changed = changed_texts(spark, d, Scratch(spark, "plain"))
    return texts.join(changed, "text").select("article_id", "field_name", "item_pos")


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every title and mention in its consistent form, with how many different texts share that form."""
    texts, changed = changed_texts(spark, d, Scratch(spark, "plain"))
    forms = texts.join(changed, "text", "left").withColumn("plain", F.coalesce("plain", "text"))
    spellings = forms.groupBy("plain").agg(F.count_distinct("text").alias("n_spellings"))
    return forms.join(spellings, "plain").select("article_id", "field_name", "item_pos", "plain", "n_spellings")


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
SQL: dict[str, str] = {}
