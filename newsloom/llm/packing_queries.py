"""Queries of problem 8: documents in containers of 2 048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.packing import pack
from newsloom.llm.tokens import Encoder
from newsloom.runtime import Scratch
from newsloom.sources import load

CAPACITY = 2048


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document (or piece of one longer than a container) with its container."""
    docs = load(spark, d, "documents").select("doc_id", "text").where("text is not null and text <> ''")
    scratch = Scratch(spark, "packing")
    sizes = Encoder(docs, "text", scratch).sizes(docs, "doc_id", "text")
    packed = pack(sizes, "doc_id", "n_tokens", CAPACITY, scratch)
    return packed.select(F.col("container").alias("container_id"), F.col("key").alias("doc_id"), "piece", F.col("size").alias("n_tokens"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of capacity in use."""
    per = p8_containers(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count("*").alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * CAPACITY), 4).alias("fill_share"),
    )


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every text is in them once and whole, none is overfull, only texts longer than a container are divided; and at most 2 % more containers than their tokens need, or one."""
    packed = Scratch(spark, "checks").keep(p8_containers(spark, d))
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("n_tokens").alias("size"))
    row = docs.agg(
        F.count("*").alias("n_docs"),
        F.count_if((F.col("n") != F.col("pieces")) | (F.col("n") != F.col("last") + 1)).alias("repeated_or_missing_pieces"),
        F.count_if((F.col("n") > 1) & (F.col("size") <= CAPACITY)).alias("divided_without_need"),
    )
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    row = row.withColumn("overfull", used.agg(F.count_if(F.col("used") > CAPACITY)).scalar())
    least = F.ceil(F.sum("used") / CAPACITY)
    return row.withColumn("too_many_containers", used.agg(F.coalesce(F.count("*") > F.greatest(F.ceil(least * 1.02), least + 1), F.lit(False)).cast("bigint")).scalar())


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_checks": p8_checks}
#: SQL has no tokenizer; it counts the texts that must be in containers, and the defects must be none.
SQL = {
    "p8_checks": """select count(*) n_docs, cast(0 as bigint) repeated_or_missing_pieces, cast(0 as bigint) divided_without_need, cast(0 as bigint) overfull, cast(0 as bigint) too_many_containers
from documents where text is not null and text <> ''""",
}
