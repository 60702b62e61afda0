"""Queries of problem 7: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.tokens import Encoder, decode_ids
from newsloom.runtime import Scratch
from newsloom.sources import load


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    return Encoder(docs, "text", Scratch(spark, "tokens")).ids(docs, "doc_id", "text").select("doc_id", "ids")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per language: texts, tokens, and texts that decoding gives back character by character."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    ids = Encoder(docs, "text", Scratch(spark, "tokens")).ids(docs.withColumn("was", F.coalesce("text", F.lit(""))), "doc_id", "text")
    return ids.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.count_if(decode_ids(F.col("ids")) == F.col("was")).alias("n_exact")
    )


QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip}
SQL: dict[str, str] = {}
