"""Validation of the raw tables: counts of every kind of defect, in one pass a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import lists
from newsloom.functions.text import blank
from newsloom.operators.ranking import Ordered
from newsloom.runtime import Scratch

QUANTILES = (0.01, 0.05, 0.25, 0.75, 0.95, 0.99)


def unpivot(row: DataFrame, value: str = "value") -> DataFrame:
    """One row of metrics as (metric, value) rows."""
    return row.unpivot([], row.columns, "metric", value)


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and ratio of each column; ratio 0 for an empty table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count("*").alias("__rows"))
    return counts.unpivot(["__rows"], df.columns, "column_name", "null_count").select(
        "column_name", "null_count", F.when(F.col("__rows") == 0, 0.0).otherwise(F.round(F.col("null_count") / F.col("__rows"), 6)).alias("null_ratio")
    )


def required_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that are missing, sorted.  ``ensure_columns`` raises on them."""
    return sorted(set(required) - set(df.columns))


def ensure_columns(df: DataFrame, required: list[str], table: str) -> DataFrame:
    missing = required_columns(df, required)
    if missing:
        raise ValueError(f"{table} lacks the columns {', '.join(missing)}")
    return df


def numeric_summary(c: Column) -> list[Column]:
    """Min, mean, median, max and interpolated quantiles; null for no values."""
    return [
        F.min(c).cast("double").alias("min"),
        F.round(F.avg(c), 6).alias("mean"),
        F.round(F.median(c), 6).alias("median"),
        F.max(c).cast("double").alias("max"),
        *[F.round(F.percentile(c, F.lit(q)), 6).alias(f"p{int(q * 100):02d}") for q in QUANTILES],
    ]


def duplicated(key: str, spread: list[str]) -> Column:
    """Whether a row's key stands in several rows; all copies count, a null key never does.

    Rows without a key may be many: they are spread over tasks by a hash of the columns ``spread``.
    """
    salt = F.when(F.col(key).isNull(), F.xxhash64(*spread))
    return F.col(key).isNotNull() & (F.count("*").over(Window.partitionBy(key, salt)) > 1)


def status(fail: Column, warn: Column) -> Column:
    return F.when(fail, "FAIL").when(warn, "WARNING").otherwise("PASS")


def catalogue(df: DataFrame, key: str) -> DataFrame:
    """Rows, columns as the file has them, and what its key is like."""
    return df.agg(
        F.count("*").alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.count_if(F.col(key).isNull()).alias("null_ids"),
        (F.count(key) - F.count_distinct(key)).alias("duplicate_excess"),
        F.count_distinct(key).alias("unique_ids"),
    )


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    """Columns and types of a table, as text."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def article_validation(a: DataFrame) -> DataFrame:
    """Defects of the article table; id defects fail, others warn."""
    # counting a key's rows before the join-free total keeps the shuffle to one number a key
    dup = a.where("article_id is not null").groupBy("article_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_id_rows"))
    out = a.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("article_id").isNull()).alias("null_id_rows"),
        F.count_if(blank(F.col("title")) & blank(F.col("subtitle"))).alias("blank_text_rows"),
        F.count_if(F.col("category").isNull()).alias("null_category_rows"),
        F.count_if(blank(F.col("category_str"))).alias("blank_category_rows"),
        F.count_if(F.col("published_time").isNull()).alias("null_time_rows"),
        F.count_if(lists.length("ner_clusters") != lists.length("entity_groups")).alias("list_mismatch_rows"),
    ).withColumn("duplicate_id_rows", dup.scalar())
    warn = sum((F.col(c) for c in ("blank_text_rows", "null_category_rows", "blank_category_rows", "null_time_rows", "list_mismatch_rows")), F.lit(0))
    return out.withColumn("status", status((F.col("null_id_rows") > 0) | (F.col("duplicate_id_rows") > 0), warn > 0))


def history_pairs(h: DataFrame) -> Column:
    """Pairs (article, time) of a history row, those with a null part dropped."""
    return F.filter(F.arrays_zip(F.col("article_id_fixed").alias("a"), F.col("impression_time_fixed").alias("t")), lambda p: p["a"].isNotNull() & p["t"].isNotNull())


def history_validation(h: DataFrame) -> DataFrame:
    """Rows that cannot be used (null or repeated user, null list, unequal lengths) and those to be put in order."""
    cols = ("impression_time_fixed", "article_id_fixed", "scroll_percentage_fixed", "read_time_fixed")
    n = F.size("article_id_fixed")
    flags = h.select(
        F.col("user_id").isNull().alias("null_user"),
        duplicated("user_id", ["article_id_fixed"]).alias("dup_user"),
        (F.col("article_id_fixed").isNull() | F.col("impression_time_fixed").isNull()).alias("null_list"),
        F.coalesce(F.size("article_id_fixed") != F.size("impression_time_fixed"), F.lit(False)).alias("mismatch"),
        F.coalesce(F.exists("article_id_fixed", lambda x: x.isNull()), F.lit(False)).alias("null_element"),
        lists.adjacent(F.transform(history_pairs(h), lambda p: p["t"]), lambda x, y: y < x).alias("falls"),
        F.greatest(*[lists.length(c) for c in cols]).alias("longest"),
        n.alias("n"),
    )
    bad = F.col("null_user") | F.col("dup_user") | F.col("null_list") | F.col("mismatch")
    return flags.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(c)).alias(f"{c}_rows") for c in ("null_user", "dup_user", "null_list", "mismatch", "null_element")],
        F.count_if(bad).alias("excluded_rows"),
        F.count_if(~bad).alias("usable_rows"),
        F.count_if(~bad & (F.col("falls") > 0)).alias("reorder_rows"),
    )


def history_profile(h: DataFrame) -> DataFrame:
    """Lengths, empty rows, order and repeats inside the lists."""
    times, ids = F.col("impression_time_fixed"), F.col("article_id_fixed")
    kept_times = F.array_compact(times)
    kept_ids = F.array_compact(ids)
    return h.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("impression_time_fixed", "article_id_fixed", "scroll_percentage_fixed", "read_time_fixed")],
        F.count_if(F.size(ids) == 0).alias("empty_rows"),
        F.count_if(F.size(ids) != F.size(times)).alias("length_mismatch_rows"),
        F.count_if(lists.adjacent(kept_times, lambda x, y: y < x) > 0).alias("falling_time_rows"),
        F.count_if(lists.adjacent(kept_times, lambda x, y: x == y) > 0).alias("equal_time_rows"),
        F.sum(F.coalesce(F.size(ids) - F.size(kept_ids), F.lit(0))).alias("null_ids"),
        F.sum(F.coalesce(F.size(kept_ids) - F.size(F.array_distinct(kept_ids)), F.lit(0))).alias("repeat_visits"),
        F.sum(lists.adjacent(kept_ids, lambda x, y: x == y)).alias("consecutive_repeats"),
    )


def click_lengths(b: DataFrame) -> DataFrame:
    """How many rows have each number of clicks, as stored and without repeats (a null kept once)."""
    raw = b.groupBy(lists.length("article_ids_clicked").alias("n")).agg(F.count("*").alias("n_rows")).select(F.lit("raw").alias("kind"), "n", "n_rows")
    unique = F.size(lists.stable_unique_keeping_null("article_ids_clicked")).cast("bigint")
    return raw.unionByName(b.groupBy(unique.alias("n")).agg(F.count("*").alias("n_rows")).select(F.lit("unique").alias("kind"), "n", "n_rows"))


def behavior_profile(b: DataFrame) -> DataFrame:
    clicks = F.size(lists.stable_unique_keeping_null("article_ids_clicked"))
    return b.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("impression_id", "user_id", "impression_time", "article_id", "article_ids_clicked", "article_ids_inview")],
        (F.count("impression_id") - F.count_distinct("impression_id")).alias("duplicate_excess"),
        F.count_if(lists.length("article_ids_clicked") != clicks).alias("rows_with_repeated_clicks"),
        F.count_if(clicks == 0).alias("no_click_rows"),
        F.count_if(clicks == 1).alias("single_click_rows"),
        F.count_if(clicks > 1).alias("multi_click_rows"),
    )


def time_disorder(b: DataFrame, scratch: Scratch) -> DataFrame:
    """Per user, neighbours in delivery order (impression_id stands for it) whose time falls or is equal.

    Neighbours are found over ranges of (user, impression), so a user with a third of all rows isn't one task.
    """
    known = b.where("user_id is not null and impression_id is not null and impression_time is not null").select("user_id", "impression_id", "impression_time").dropDuplicates(["user_id", "impression_id"])
    step = Ordered(known, ["user_id"], ["impression_id"], scratch).before(["impression_time"]).rows
    step = step.select("user_id", (F.col("impression_time") < F.col("prev_impression_time")).alias("falls"), (F.col("impression_time") == F.col("prev_impression_time")).alias("same"))
    per = step.groupBy("user_id").agg(F.count_if("falls").alias("falls"), F.count_if("same").alias("same"))
    return per.agg(F.count("*").alias("users"), F.count_if(F.col("falls") > 0).alias("users_falling"), F.sum("falls").alias("falling_pairs"), F.sum("same").alias("equal_pairs"))


def unsorted_users(h: DataFrame, sample: int = 20) -> DataFrame:
    """Users whose history falls in time somewhere: how many, and the first ones by id."""
    times = F.array_compact("impression_time_fixed")
    bad = h.where(F.col("user_id").isNotNull()).where(lists.adjacent(times, lambda x, y: y < x) > 0).select("user_id").distinct()
    few = bad.orderBy("user_id").limit(sample).agg(lists.text_of(F.sort_array(F.collect_list("user_id"))).alias("examples"))  # the limit is the feature
    return bad.agg(F.count("*").alias("users_falling")).withColumn("examples", few.scalar())


def usable_flags(b: DataFrame, need_inview: bool) -> DataFrame:
    """``b`` with a flag for each reason of exclusion and ``usable``.

    With ``need_inview`` an in-view list without any id excludes, as does a click
    outside it; membership is looked at only where both lists have ids.
    """
    clicks, seen = lists.stable_unique("article_ids_clicked"), lists.stable_unique("article_ids_inview")
    no_click = F.size(clicks) == 0
    no_view = F.size(seen) == 0
    out = b.withColumns(
        {
            "bad_impression": F.col("impression_id").isNull() | duplicated("impression_id", ["user_id", "impression_time"]),
            "bad_user": F.col("user_id").isNull(),
            "bad_time": F.col("impression_time").isNull(),
            "bad_click": no_click,
            "bad_inview": (no_view if need_inview else F.lit(False)),
            "bad_member": ((~no_click & ~no_view & (F.size(F.array_except(clicks, seen)) > 0)) if need_inview else F.lit(False)),
        }
    )
    reasons = ("bad_impression", "bad_user", "bad_time", "bad_click", "bad_inview", "bad_member")
    bad = F.lit(False)
    for r in reasons:
        bad = bad | F.col(r)
    return out.withColumn("usable", ~bad)


def behavior_validation(b: DataFrame, split: str) -> DataFrame:
    flags = usable_flags(b, split == "validation")
    clicks = F.size(lists.stable_unique("article_ids_clicked"))
    null_in = lambda c: F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
    known = lambda c: F.size(F.array_compact(F.coalesce(c, F.array())))
    return flags.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(c)).alias(f"{c}_rows") for c in ("bad_impression", "bad_user", "bad_time", "bad_click", "bad_inview", "bad_member")],
        F.count_if("usable").alias("usable_rows"),
        F.count_if(~F.col("usable")).alias("excluded_rows"),
        F.count_if(F.col("usable") & (clicks == 1)).alias("usable_single_click_rows"),
        F.count_if(F.col("usable") & (clicks > 1)).alias("usable_multi_click_rows"),
        F.count_if(F.col("article_id").isNull()).alias("null_current_rows"),
        *[F.count_if(F.col(f"article_ids_{c}").isNull()).alias(f"null_{c}_rows") for c in ("clicked", "inview")],
        *[F.count_if(F.size(f"article_ids_{c}") == 0).alias(f"empty_{c}_rows") for c in ("clicked", "inview")],
        *[F.count_if(null_in(f"article_ids_{c}")).alias(f"null_element_{c}_rows") for c in ("clicked", "inview")],
        *[F.count_if(F.size(lists.stable_unique(f"article_ids_{c}")) < known(f"article_ids_{c}")).alias(f"repeated_{c}_rows") for c in ("clicked", "inview")],
        F.count_if(F.col("impression_id").isNull()).alias("null_impression_rows"),
    ).select(F.lit(split).alias("split"), "*")


def references(b: DataFrame, h: DataFrame) -> DataFrame:
    """Every article reference of a split: ``kind, row_key, article_id``."""
    parts = [
        h.select(F.lit("history").alias("kind"), F.col("user_id").alias("row_key"), F.explode(F.col("article_id_fixed").cast("array<bigint>")).alias("article_id")),
        b.select(F.lit("current").alias("kind"), F.col("impression_id").alias("row_key"), F.col("article_id").cast("bigint").alias("article_id")),
        b.select(F.lit("clicked").alias("kind"), F.col("impression_id").alias("row_key"), F.explode(F.col("article_ids_clicked").cast("array<bigint>")).alias("article_id")),
        b.select(F.lit("inview").alias("kind"), F.col("impression_id").alias("row_key"), F.explode(F.col("article_ids_inview").cast("array<bigint>")).alias("article_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("article_id is not null")


def missing_references(refs: DataFrame, articles: DataFrame, examples: int = 10) -> DataFrame:
    """References without an article, per kind: how many, in how many rows, how many ids, and the smallest ids.

    Counts are first taken per (kind, article), so only a referenced id is looked up, not each reference.
    """
    known = articles.where("article_id is not null").select(F.col("article_id").cast("bigint")).distinct()
    lost = refs.join(known, "article_id", "left_anti")
    per_id = lost.groupBy("kind", "article_id").agg(F.count("*").alias("n"))
    ids = per_id.groupBy("kind").agg(F.sum("n").alias("n_references"), F.count("*").alias("n_ids"))
    # the filter on the rank lets each task keep its smallest ids only, before anything is shuffled
    few = per_id.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("article_id"))).where(F.col("rank") <= examples)
    ids = ids.join(few.groupBy("kind").agg(lists.text_of(F.sort_array(F.collect_list("article_id"))).alias("examples")), "kind")
    rows = lost.groupBy("kind").agg(F.count_distinct("row_key").alias("n_rows"))
    return ids.join(rows, "kind")


def users_without_history(b: DataFrame, h: DataFrame, examples: int = 10) -> DataFrame:
    """Users of behaviour that no history row names: rows, users and the first ids."""
    lost = b.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n")).join(h.select("user_id").where("user_id is not null").distinct(), "user_id", "left_anti")
    few = lost.orderBy("user_id").limit(examples).agg(lists.text_of(F.sort_array(F.collect_list("user_id"))).alias("examples"))
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_users")).withColumn("examples", few.scalar())


def user_overlap(h: DataFrame, b: DataFrame) -> DataFrame:
    """Users of history and behaviour: five set sizes."""
    u = h.select("user_id").distinct().withColumn("in_h", F.lit(1)).join(b.select("user_id").distinct().withColumn("in_b", F.lit(1)), "user_id", "full_outer").where("user_id is not null")
    return u.agg(
        F.count("in_h").alias("history_users"),
        F.count("in_b").alias("behavior_users"),
        F.count_if(F.col("in_h").isNotNull() & F.col("in_b").isNotNull()).alias("both_sides"),
        F.count_if(F.col("in_b").isNull()).alias("history_only"),
        F.count_if(F.col("in_h").isNull()).alias("behavior_only"),
    )
