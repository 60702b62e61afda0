"""Entity mentions: normalisation maps fitted on train articles, statistics, diagnostics and rule inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.lists import text_of
from newsloom.functions.text import entity_group, entity_key, entity_text, word_tokens

#: Dashes read as a hyphen.
DASHES = "‐‑‒–—−﹘﹣－"
#: Apostrophes, double quotes and zero-width characters.
APOSTROPHES = "‘’‛ʼ＇´`"
DOUBLE_QUOTES = "“”„‟＂"
ZERO_WIDTH = "​‌‍⁠﻿"
#: Words left out when alias rules look for acronyms, and first words that an acronym holds whole.
ALIAS_STOP_WORDS = ("a", "af", "and", "av", "de", "den", "der", "det", "for", "i", "in", "of", "og", "the", "til", "von", "van")
WHOLE_WORDS = ("ac", "afc", "bk", "cf", "fc", "fk", "hc", "if", "ik", "rc", "sc", "sk", "sv", "tv", "uc")
#: Words left out when short forms of organisations are linked to their names.
LINK_STOP_WORDS = ("a", "af", "and", "for", "i", "of", "og", "the", "til")
#: Legal suffixes, as their parts.
LEGAL_SUFFIXES = (
    ("a", "s"), ("as",), ("aps",), ("a", "m", "b", "a"), ("amba",), ("ab",), ("ag",), ("bv",), ("corp",), ("corporation",), ("gmbh",), ("inc",),
    ("incorporated",), ("limited",), ("llc",), ("ltd",), ("nv",), ("oy",), ("oyj",), ("plc",), ("sa",),
)


def mentions(articles: DataFrame, train_ids: DataFrame) -> DataFrame:
    """One row a mention: raw and normalised text, group, key and whether train uses the article.

    Blank mentions and groups are dropped; the position is that in the raw list.
    """
    pairs = articles.select("article_id", F.posexplode(F.arrays_zip("ner_clusters", "entity_groups")).alias("entity_position", "e")).select(
        "article_id", F.col("entity_position").cast("bigint"), F.col("e.ner_clusters").alias("raw_entity"), F.col("e.entity_groups").alias("raw_entity_group")
    )
    normal = pairs.where("raw_entity is not null and raw_entity_group is not null").withColumns(
        {"normalized_entity": entity_text(F.col("raw_entity")), "entity_group": entity_group(F.col("raw_entity_group"))}
    )
    kept = normal.where("normalized_entity <> '' and entity_group <> ''").withColumn("baseline_entity_key", entity_key(F.col("entity_group"), F.col("normalized_entity")))
    return kept.join(train_ids.select("article_id").distinct().withColumn("is_train_used", F.lit(True)), "article_id", "left").withColumn("is_train_used", F.coalesce("is_train_used", F.lit(False)))


def document_frequency(m: DataFrame, text: str) -> DataFrame:
    """``entity_group, entity, df``: train articles each surface stands in."""
    return m.where("is_train_used").groupBy("entity_group", F.col(text).alias("entity")).agg(F.count_distinct("article_id").alias("df"))


def possessive_candidates(df: DataFrame) -> DataFrame:
    """Surfaces that are another surface of the group followed by s, with both frequencies."""
    base = df.select("entity_group", F.col("entity").alias("base_entity"), F.col("df").alias("base_df"))
    variant = df.where(F.col("entity").endswith("s")).select("entity_group", F.col("entity").alias("variant_entity"), F.col("df").alias("variant_df"), F.expr("left(entity, length(entity) - 1)").alias("base_entity"))
    return variant.join(base, ["entity_group", "base_entity"])


def safe_possessive(c: DataFrame) -> DataFrame:
    """Candidates that pass every guard."""
    return c.where(
        F.col("entity_group").isin("PER", "ORG", "LOC")
        & (F.length("base_entity") >= 3)
        & (F.col("base_df") >= 2)
        & (F.col("base_df") >= F.col("variant_df"))
        & ((F.col("entity_group") != "PER") | F.col("base_entity").contains(" "))
    )


def hyphen_candidate(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.translate(c, DASHES, "-" * len(DASHES)), "-", " "), r"(?U)\s+", " "))


def hyphen_map(surfaces: DataFrame) -> DataFrame:
    """``entity_group, variant_entity, base_entity``: hyphenated surfaces whose spaced form is a train surface too.

    ``surfaces``: distinct ``entity_group, entity`` of train mentions.
    """
    dashed = F.translate("entity", DASHES, "-" * len(DASHES))
    v = surfaces.select("entity_group", F.col("entity").alias("variant_entity"), hyphen_candidate(F.col("entity")).alias("base_entity"), dashed.alias("dashed"))
    v = v.where((F.col("variant_entity") != F.col("base_entity")) & ~F.col("dashed").startswith("-") & ~F.col("dashed").endswith("-"))
    return v.join(surfaces.select("entity_group", F.col("entity").alias("base_entity")), ["entity_group", "base_entity"], "left_semi").select("entity_group", "variant_entity", "base_entity")


def article_entities(m: DataFrame, mode: str = "normalize_only", version: str = "v2") -> DataFrame:
    """Mentions with ``canonical_entity``, its key and how it came about.

    Maps are fitted on train mentions and applied to all, each once: possessive
    first, then (v2) hyphen on the result.  ``baseline`` leaves mentions as they are.
    """
    if mode not in ("baseline", "normalize_only") or version not in ("v1", "v2"):
        raise ValueError(f"mode {mode} with version {version} isn't supported")
    if mode == "baseline":
        done = m.withColumns({"canonical_entity": F.col("normalized_entity"), "processing_method": F.lit("baseline")})
    else:
        pos = safe_possessive(possessive_candidates(document_frequency(m, "normalized_entity"))).select(
            "entity_group", F.col("variant_entity").alias("normalized_entity"), F.col("base_entity").alias("possessive")
        )
        one = m.join(pos, ["entity_group", "normalized_entity"], "left").withColumn("first", F.coalesce("possessive", "normalized_entity"))
        hyphen = F.lit(None).cast("string")
        if version == "v2":
            surfaces = one.where("is_train_used").select("entity_group", F.col("first").alias("entity")).distinct()
            hyp = hyphen_map(surfaces).select("entity_group", F.col("variant_entity").alias("first"), F.col("base_entity").alias("spaced"))
            one = one.join(hyp, ["entity_group", "first"], "left")
            hyphen = F.col("spaced")
        done = one.withColumns(
            {
                "canonical_entity": F.coalesce(hyphen, "first"),
                "processing_method": F.coalesce(
                    F.nullif(F.concat_ws("+", F.when(F.col("possessive").isNotNull(), "safe_possessive_v1"), F.when(hyphen.isNotNull(), "safe_hyphen_v2")), F.lit("")), F.lit("baseline")
                ),
            }
        )
    return done.withColumn("canonical_entity_key", entity_key(F.col("entity_group"), F.col("canonical_entity"))).select(
        "article_id", "entity_position", "raw_entity", "raw_entity_group", "entity_group", "normalized_entity", "baseline_entity_key", "canonical_entity", "canonical_entity_key", "processing_method", "is_train_used",
    )


def entity_sets(entities: DataFrame, key: str = "canonical_entity_key") -> DataFrame:
    """Distinct (article, key)."""
    return entities.select("article_id", F.col(key).alias("entity")).distinct()


def token_containment(df: DataFrame) -> DataFrame:
    """Single-token surfaces that are a token of a longer surface of the group: equi-join on (group, token)."""
    short = df.where(~F.col("entity").contains(" ")).select("entity_group", F.col("entity").alias("short_entity"), F.col("df").alias("short_df"))
    full = df.where(F.col("entity").contains(" ")).select("entity_group", F.col("entity").alias("full_entity"), F.col("df").alias("full_df"), F.explode(F.array_distinct(F.split("entity", " "))).alias("short_entity"))
    return short.join(full, ["entity_group", "short_entity"])


def cooccurrence(pairs: DataFrame, sets: DataFrame, left: str, right: str, examples: int = 5) -> DataFrame:
    """``pairs`` (keys in ``left`` and ``right``) with the number of articles both stand in, and the first ones' ids.

    Pairs meet the articles of their left side, then the right side on (article, key): no article forms all its pairs.
    """
    a = sets.select("article_id", F.col("entity").alias(left))
    b = sets.select("article_id", F.col("entity").alias(right))
    together = pairs.select(left, right).distinct().join(a, left).join(b, ["article_id", right]).select(left, right, "article_id")
    # each task keeps a pair's first ids only, before anything is shuffled
    few = together.withColumn("nth", F.row_number().over(Window.partitionBy(left, right).orderBy("article_id"))).where(F.col("nth") <= examples)
    shown = few.groupBy(left, right).agg(text_of(F.sort_array(F.collect_list("article_id"))).alias("example_ids"))
    counted = together.groupBy(left, right).agg(F.count("*").alias("n_articles"), F.min("article_id").alias("first_article"))
    return pairs.join(counted, [left, right], "left").join(shown, [left, right], "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))


def surface_statistics(e: DataFrame, column: str = "canonical_entity") -> DataFrame:
    """``entity_group, entity, df, mentions`` of the surfaces of train mentions."""
    return e.where("is_train_used").groupBy("entity_group", F.col(column).alias("entity")).agg(F.count_distinct("article_id").alias("df"), F.count("*").alias("mentions"))


def rule_transforms(c: Column) -> dict[str, Column]:
    """The inspected rewriting rules, by name."""

    def tidy(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))

    apostrophe = F.translate(c, APOSTROPHES, "'" * len(APOSTROPHES))
    quotes = F.translate(c, DOUBLE_QUOTES, '"' * len(DOUBLE_QUOTES))
    dashed = F.translate(c, DASHES, "-" * len(DASHES))
    unquoted = tidy(F.translate(apostrophe, DOUBLE_QUOTES, '"' * len(DOUBLE_QUOTES)))
    return {
        "zero_width": tidy(F.translate(c, ZERO_WIDTH, "")),
        "apostrophe": tidy(apostrophe),
        "double_quote": tidy(quotes),
        "dash": tidy(dashed),
        "hyphen_spacing": tidy(F.regexp_replace(dashed, r"(?U)\s*-\s*", "-")),
        "hyphen_vs_space": tidy(F.regexp_replace(dashed, r"(?U)\s*-\s*", " ")),
        "outer_quotes": tidy(F.regexp_replace(unquoted, r"""^(["'])(.*)\1$""", "$2")),
        "terminal_punctuation": tidy(F.regexp_replace(tidy(c), r"[.,;:!?]+$", "")),
    }


def rule_buckets(surfaces: DataFrame) -> DataFrame:
    """What each rule would bring together: ``rule, entity_group, canonical``, the rewritten text, and ``members``.

    A bucket holds two surfaces or more, of which the rule changes one at least;
    an empty result makes none.  ``members`` are structs (entity, df, mentions)
    by falling df, falling mentions and text.  ``surfaces``: see ``surface_statistics``.
    """
    rules = rule_transforms(F.col("entity"))
    stacked = surfaces.select("entity_group", "entity", "df", "mentions", F.explode(F.create_map(*[x for n, e in rules.items() for x in (F.lit(n), e)])).alias("rule", "canonical"))
    order = F.struct((-F.col("df")).alias("d"), (-F.col("mentions")).alias("m"), "entity")
    # a bucket holds the spellings of one text, so it is small
    made = stacked.where("canonical <> ''").groupBy("rule", "entity_group", "canonical").agg(F.sort_array(F.collect_list(order)).alias("s"), F.bool_or(F.col("entity") != F.col("canonical")).alias("changed"))
    return made.where("size(s) > 1 and changed").select("rule", "entity_group", "canonical", F.transform("s", lambda x: F.struct(x["entity"].alias("entity"), (-x["d"]).alias("df"), (-x["m"]).alias("mentions"))).alias("members"))


def rule_collisions(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """One row a bucket: whether its text is a surface already, its surfaces in order, and the articles they stand in together.

    ``sets``: distinct ``article_id, entity_group, entity`` of train.
    """
    each = buckets.select("rule", "entity_group", "canonical", F.explode("members.entity").alias("entity"))
    union = each.join(sets, ["entity_group", "entity"]).groupBy("rule", "entity_group", "canonical").agg(F.count_distinct("article_id").alias("union_df"))
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    return buckets.join(union, ["rule", "entity_group", "canonical"]).select(
        "rule", "entity_group", "canonical", F.array_contains("members.entity", F.col("canonical")).alias("observed"), F.size("members").cast("bigint").alias("surface_count"),
        shown("members.entity").alias("surfaces"), shown("members.df").alias("surface_dfs"), shown("members.mentions").alias("surface_mentions"), "union_df",
    )


def rule_mappings(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """One row a surface that a rule changes: the text it becomes, both frequencies, and the articles both stand in."""
    m = buckets.select("rule", "entity_group", "canonical", "members", F.explode("members").alias("v")).where("v.entity <> canonical")
    own = F.filter("members", lambda x: x["entity"] == F.col("canonical"))
    m = m.select("rule", "entity_group", F.col("v.entity").alias("variant"), "canonical", F.col("v.df").alias("variant_df"), F.coalesce(F.get(own, F.lit(0))["df"], F.lit(0)).alias("canonical_df"), (F.size(own) > 0).alias("observed"))
    key = lambda c: F.struct("entity_group", F.col(c).alias("entity"))
    seen = cooccurrence(m.withColumns({"a": key("variant"), "b": key("canonical")}), sets.select("article_id", F.struct("entity_group", "entity").alias("entity")), "a", "b")
    return seen.select("rule", "entity_group", "variant", "canonical", "variant_df", "canonical_df", "observed", F.col("n_articles").alias("cooccurrence"))


def rule_summary(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Per rule with an effect: buckets, changed surfaces and articles concerned."""
    each = buckets.select("rule", "entity_group", "canonical", F.explode("members.entity").alias("entity"))
    counts = each.groupBy("rule").agg(F.count_distinct("entity_group", "canonical").alias("collision_groups"), F.count_if(F.col("entity") != F.col("canonical")).alias("mapping_candidates"))
    return counts.join(each.join(sets, ["entity_group", "entity"]).groupBy("rule").agg(F.count_distinct("article_id").alias("affected_articles")), "rule")


def character_inventory(m: DataFrame) -> DataFrame:
    """Punctuation and format characters of mentions: occurrences, articles, surfaces."""
    chars = m.select("article_id", "normalized_entity", F.explode(F.split("normalized_entity", "")).alias("ch")).where(F.col("ch").rlike(r"^[\p{P}\p{Cf}]$"))
    return chars.groupBy("ch").agg(F.count("*").alias("occurrences"), F.count_distinct("article_id").alias("articles"), F.count_distinct("normalized_entity").alias("surfaces"))


def acronym_signatures(c: Column) -> Column:
    """Acronyms an organisation's name may have: its initials, and those with its ``WHOLE_WORDS`` unshortened; 2 to 8 characters, of two words at least."""
    words = F.filter(word_tokens(c), lambda x: ~x.isin(*ALIAS_STOP_WORDS))
    first = lambda x: F.left(x, F.lit(1))
    initials = F.array_join(F.transform(words, first), "")
    expanded = F.array_join(F.transform(words, lambda x: F.when(x.isin(*WHOLE_WORDS), x).otherwise(first(x))), "")
    return F.when(F.size(words) >= 2, F.array_distinct(F.filter(F.array(initials, expanded), lambda x: F.length(x).between(2, 8)))).otherwise(F.array().cast("array<string>"))


def link_acronym(c: Column) -> Column:
    """Short form of an organisation's name that links look for, or null.

    Words end at white space and lose what isn't a letter or digit; those of up to
    three letters, or three digits, stay whole, of others the first character counts.
    """
    words = F.transform(F.split(c, r"(?U)\s+"), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")))
    words = F.filter(words, lambda x: (x != "") & ~x.isin(*LINK_STOP_WORDS))
    short = F.array_join(F.transform(words, lambda x: F.when((F.length(x) <= 3) & (x.rlike(r"^\p{L}+$") | x.rlike(r"^\p{N}+$")), x).otherwise(F.left(x, F.lit(1)))), "")
    return F.when((F.size(words) >= 2) & (F.length(short) >= 2) & (short != c), short)


def compact(c: Column) -> Column:
    return F.array_join(word_tokens(c), "")


def collapsed(c: Column) -> Column:
    """Letter-digit words, one space between them, neighbouring single letters as one word."""
    return F.regexp_replace(F.array_join(word_tokens(c), " "), r"(?<=(?:^|\s)\p{L}) (?=\p{L}(?:\s|$))", "")


def acronym_candidates(df: DataFrame) -> DataFrame:
    """ORG surfaces of one word of 2 to 8 letters and digits that are an acronym of a longer one; ``n_longs`` longs compete for a short one."""
    orgs = df.where("entity_group = 'ORG'")
    long = orgs.select(F.col("entity").alias("long_entity"), F.col("df").alias("long_df"), F.explode(acronym_signatures(F.col("entity"))).alias("signature"))
    word = compact(F.col("entity"))
    short = orgs.where((F.size(word_tokens(F.col("entity"))) == 1) & F.length(word).between(2, 8)).select(F.col("entity").alias("short_entity"), F.col("df").alias("short_df"), word.alias("signature"))
    met = long.join(short, "signature").where("short_entity <> long_entity")
    return met.join(met.groupBy("short_entity").agg(F.count("*").alias("n_longs")), "short_entity")


def punctuation_candidates(df: DataFrame) -> DataFrame:
    """Pairs of ORG surfaces of equal words but for punctuation; the more frequent one is canonical, the first by text among equals.

    A group holds the punctuations of one text, so it is small; pairs are the result.
    """
    s = df.where("entity_group = 'ORG'").select("entity", "df", collapsed(F.col("entity")).alias("signature")).where("signature <> ''")
    n = s.groupBy("signature").agg(F.count("*").alias("group_size")).where("group_size > 1")
    left = s.join(n, "signature").select("signature", "group_size", F.col("entity").alias("l"), F.col("df").alias("l_df"))
    pairs = left.join(s.select("signature", F.col("entity").alias("r"), F.col("df").alias("r_df")), "signature").where("l < r")
    swap = F.col("r_df") > F.col("l_df")
    pick = lambda a, b, name: F.when(swap, F.col(a)).otherwise(F.col(b)).alias(name)
    p = pairs.select("signature", "group_size", pick("l", "r", "variant"), pick("r", "l", "canonical"), pick("l_df", "r_df", "variant_df"), pick("r_df", "l_df", "canonical_df"))
    return p.withColumn("tier", F.when((F.col("group_size") == 2) & (F.col("canonical_df") >= 2), "SAFE").otherwise("REVIEW"))


def legal_suffix_candidates(df: DataFrame) -> DataFrame:
    """ORG surfaces that are another surface and a legal suffix, the longest suffix first."""
    words = F.array_join(word_tokens(F.col("entity")), " ")
    pattern = "^(.+?) (?:" + "|".join(sorted(map(" ".join, LEGAL_SUFFIXES), key=lambda x: (-len(x), x))) + ")$"
    orgs = df.where("entity_group = 'ORG'")
    v = orgs.select(F.col("entity").alias("variant"), F.col("df").alias("variant_df"), F.regexp_extract(words, pattern, 1).alias("base")).where("base <> ''")
    b = orgs.select(F.col("entity").alias("canonical"), F.col("df").alias("canonical_df"), words.alias("base"))
    return v.join(b, "base").where("variant <> canonical").select("variant", "canonical", "variant_df", "canonical_df", F.when((F.col("canonical_df") >= 2) & (F.col("canonical_df") >= F.col("variant_df")), "SAFE").otherwise("REVIEW").alias("tier"))


def short_form_candidates(df: DataFrame) -> DataFrame:
    """ORG surfaces that are another one without one or two words at an end; for review only."""
    orgs = df.where("entity_group = 'ORG'")
    t = F.split("entity", " ")
    n = F.size(t)
    cuts = F.array(*[F.struct(F.lit(name).alias("cut"), F.when(n > k, F.array_join(F.slice(t, start, F.greatest(n - k, F.lit(1))), " ")).alias("base")) for name, k, start in (("prefix1", 1, 2), ("prefix2", 2, 3), ("suffix1", 1, 1), ("suffix2", 2, 1))])
    v = orgs.select(F.col("entity").alias("variant"), F.col("df").alias("variant_df"), F.inline(cuts)).where("base is not null and length(base) >= 5")
    return v.join(orgs.select(F.col("entity").alias("base"), F.col("df").alias("base_df")), "base").select("variant", "base", "cut", "variant_df", "base_df")
