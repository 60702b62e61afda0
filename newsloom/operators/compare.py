"""Two clusterings of the same articles side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_summary(events: DataFrame) -> DataFrame:
    """``events``: article_id, event_id."""
    n = events.groupBy("event_id").agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").cast("double").alias("events"),
        F.sum("n").cast("double").alias("articles"),
        F.count_if(F.col("n") == 1).cast("double").alias("singletons"),
        F.coalesce(F.round(F.count_if(F.col("n") == 1) / F.count("*"), 6), F.lit(0.0)).alias("singleton_ratio"),
        F.count_if(F.col("n") > 1).cast("double").alias("multi"),
        F.round(F.avg("n"), 6).alias("mean_size"),
        F.median("n").alias("median_size"),
        F.max("n").cast("double").alias("largest"),
    )


def idf_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entities whose frequency or standing differs; unchanged ones are dropped."""
    cols = ("document_frequency", "is_high_df")
    j = left.select("entity", *[F.col(c).alias(f"l_{c}") for c in cols]).join(right.select("entity", *[F.col(c).alias(f"r_{c}") for c in cols]), "entity", "full_outer")
    kind = (
        F.when(F.col("l_document_frequency").isNull(), "VOCABULARY_ADDED")
        .when(F.col("r_document_frequency").isNull(), "VOCABULARY_REMOVED")
        .when(~F.col("l_is_high_df") & F.col("r_is_high_df"), "BECAME_HIGH_DF")
        .when(F.col("l_is_high_df") & ~F.col("r_is_high_df"), "LEFT_HIGH_DF")
        .when(F.col("l_document_frequency") != F.col("r_document_frequency"), "DF_CHANGED")
    )
    return j.withColumn("change", kind).where("change is not null").select("entity", "change", F.col("l_document_frequency").alias("left_df"), F.col("r_document_frequency").alias("right_df"))


def coclustered_pairs(events: DataFrame) -> DataFrame:
    """Pairs of articles in one event, the smaller id first; events are small, their largest size is reported by ``size_summary``."""
    a = events.select("event_id", F.col("article_id").alias("article_a"))
    b = events.select("event_id", F.col("article_id").alias("article_b"))
    return a.join(b, "event_id").where("article_a < article_b").select("article_a", "article_b")


def pair_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Co-clustered pairs of one side only, with the events of both articles on both sides.

    Only pairs of the result are formed: within an event of one side, articles meet
    those of another event of the other side; an event that is the same on both
    sides, however large, forms none.
    """
    j = left.select("article_id", F.col("event_id").alias("l")).join(right.select("article_id", F.col("event_id").alias("r")), "article_id")

    def differ(own: str, other: str, change: str) -> DataFrame:
        several = j.groupBy(own).agg(F.count_distinct(other).alias("n")).where("n > 1").select(own)
        part = j.join(several, own, "left_semi")
        a = part.select(F.col(own).alias("e"), *[F.col(c).alias(f"{c}_a") for c in ("article_id", "l", "r")])
        b = part.select(F.col(own).alias("e"), *[F.col(c).alias(f"{c}_b") for c in ("article_id", "l", "r")])
        return a.join(b, "e").where(F.col(f"{other}_a") != F.col(f"{other}_b")).where("article_id_a < article_id_b").select(
            F.lit(change).alias("change"), F.col("article_id_a").alias("article_a"), F.col("article_id_b").alias("article_b"), F.col("l_a").alias("left_event_a"), F.col("l_b").alias("left_event_b"), F.col("r_a").alias("right_event_a"), F.col("r_b").alias("right_event_b"),
        )

    return differ("r", "l", "ADDED").unionByName(differ("l", "r", "REMOVED"))


def pair_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many co-clustered pairs both sides have, and either side only, from the sizes of events and of what they share."""
    two = lambda c: F.coalesce(F.sum(F.expr(f"{c} * ({c} - 1) div 2")), F.lit(0)).cast("bigint")
    cells = left.select("article_id", F.col("event_id").alias("l")).join(right.select("article_id", F.col("event_id").alias("r")), "article_id").groupBy("l", "r").agg(F.count("*").alias("n"))
    both = cells.agg(two("n").alias("common_pairs"))
    l, r = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(two("n")) for c in ("l", "r"))
    return both.withColumns({"removed_pairs": l.scalar() - F.col("common_pairs"), "added_pairs": r.scalar() - F.col("common_pairs")})


def require_same_articles(left: DataFrame, right: DataFrame) -> None:
    """Two clusterings can be compared only if each holds every article once and both hold the same ones."""
    for name, side in (("left", left), ("right", right)):
        n = side.agg((F.count("*") - F.count_distinct("article_id")).alias("n")).first()["n"]
        if n:
            raise ValueError(f"the {name} clustering holds {n} repeated or null articles")
    ids = left.select("article_id", F.lit(1).alias("l")).join(right.select("article_id", F.lit(1).alias("r")), "article_id", "full_outer")
    lost = ids.agg(F.count_if(F.col("l").isNull()).alias("l"), F.count_if(F.col("r").isNull()).alias("r")).first()
    if lost["l"] or lost["r"]:
        raise ValueError(f"{lost['l']} articles are in the right clustering only, {lost['r']} in the left only")


def merges_and_splits(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right events that span several left ones (merge), and left events that span several right ones (split)."""
    j = left.select("article_id", F.col("event_id").alias("l")).join(right.select("article_id", F.col("event_id").alias("r")), "article_id")
    merged = j.groupBy("r").agg(F.count_distinct("l").alias("n"), F.count("*").alias("n_articles")).where("n > 1").select(F.lit("MERGE").alias("kind"), F.col("r").alias("event_id"), "n", "n_articles")
    split = j.groupBy("l").agg(F.count_distinct("r").alias("n"), F.count("*").alias("n_articles")).where("n > 1").select(F.lit("SPLIT").alias("kind"), F.col("l").alias("event_id"), "n", "n_articles")
    return merged.unionByName(split)


def metric_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """One-row metrics of both sides as (metric, left, right, delta, ratio); the ratio is null where left is 0."""
    a = left.unpivot([], left.columns, "metric", "left_value")
    b = right.unpivot([], right.columns, "metric", "right_value")
    return a.join(b, "metric").select("metric", "left_value", "right_value", F.round(F.col("right_value") - F.col("left_value"), 6).alias("delta"), F.when(F.col("left_value") != 0, F.round((F.col("right_value") - F.col("left_value")) / F.col("left_value"), 6)).alias("ratio"))
