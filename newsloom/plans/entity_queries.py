"""Queries over entity mentions: normalisation, statistics, diagnostics, rule inspection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import entities as E
from newsloom.operators.quality import unpivot
from newsloom.functions.text import entity_key
from newsloom.plans.base import articles, entity_group_sql, entity_text_sql
from newsloom.plans.catalog_queries import WITH as CATALOG
from newsloom.plans.catalog_queries import train_ids, valid
from newsloom.runtime import Scratch


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """The mention table, written once: every map and statistic reads it again."""
    return Scratch(spark, "mentions").keep(E.mentions(valid(spark, d), train_ids(spark, d)))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return E.article_entities(_mentions(spark, d))


def respelled(m: DataFrame) -> DataFrame:
    """Mentions as careless editors would write them, by article: the same in Spark and SQL.

    The given tables hold hardly a hyphen, acronym or legal suffix; so the rules
    that look for these, and the comparison of clusterings with and without them,
    read all mentions with the names of every seventh article hyphenated, of the
    next with a genitive s, then with a suffix, as an acronym, with full stops,
    with a word added, and of the last as they stand.
    """
    e, org, many = F.col("normalized_entity"), F.col("entity_group") == "ORG", F.col("normalized_entity").contains(" ")
    kind = F.pmod("article_id", F.lit(7))
    initials = F.array_join(F.transform(F.split(e, " "), lambda x: F.left(x, F.lit(1))), "")
    new = (
        F.when((kind == 0) & many, F.translate(e, " ", "-"))
        .when(kind == 1, F.concat(e, F.lit("s")))
        .when((kind == 2) & org, F.concat(e, F.lit(" a/s")))
        .when((kind == 3) & org & many, initials)
        .when((kind == 4) & org, F.replace(e, F.lit(" "), F.lit(". ")))
        .when((kind == 5) & org, F.concat(e, F.lit(" gruppen")))
        .otherwise(e)
    )
    return m.withColumn("normalized_entity", new).withColumn("baseline_entity_key", entity_key(F.col("entity_group"), F.col("normalized_entity")))


def _respelled(spark: SparkSession, d: str, version: str = "v2") -> DataFrame:
    """Canonical mentions of the respelled text, written once."""
    scratch = Scratch(spark, "respelled")
    return scratch.keep(E.article_entities(scratch.keep(respelled(_mentions(spark, d))), version=version))


def _df(spark: SparkSession, d: str) -> DataFrame:
    return E.document_frequency(_mentions(spark, d), "normalized_entity")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d)


def possessive_map(spark: SparkSession, d: str) -> DataFrame:
    return E.safe_possessive(E.possessive_candidates(_df(spark, d)))


def possessive_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All possessive candidates of more than two letters, guarded or not."""
    return E.possessive_candidates(_df(spark, d)).where("length(variant_entity) > 2")


def hyphen_map(spark: SparkSession, d: str) -> DataFrame:
    """Hyphen map of the respelled mentions."""
    e = _respelled(spark, d, "v1").where("is_train_used")
    return E.hyphen_map(e.select("entity_group", F.col("canonical_entity").alias("entity")).distinct())


def article_entities(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).select("article_id", "entity_position", "baseline_entity_key", "canonical_entity_key", "processing_method", "is_train_used")


def normalization_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and articles each method changed, and distinct (article, key) before and after."""
    e = _entities(spark, d)
    return e.agg(
        F.count("*").alias("n_mentions"),
        F.count_if(F.col("baseline_entity_key") != F.col("canonical_entity_key")).alias("changed_mentions"),
        F.count_distinct(F.when(F.col("baseline_entity_key") != F.col("canonical_entity_key"), F.col("article_id"))).alias("changed_articles"),
        F.count_distinct("article_id", "baseline_entity_key").alias("pairs_before"),
        F.count_distinct("article_id", "canonical_entity_key").alias("pairs_after"),
    )


def entity_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each article's entities, in order."""
    return E.entity_sets(_entities(spark, d)).groupBy("article_id").agg(F.count("*").alias("n_entities"), F.array_join(F.sort_array(F.collect_list("entity")), "|").alias("entities"))


def list_mismatch(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    n, g = F.size("ner_clusters"), F.size("entity_groups")
    return a.agg(
        F.count_if(F.col("ner_clusters").isNull()).alias("null_lists"), F.count_if(n == 0).alias("empty_lists"), F.count_if(F.coalesce(n, F.lit(0)) != F.coalesce(g, F.lit(0))).alias("mismatched"),
    )


def entity_group_stats(spark: SparkSession, d: str) -> DataFrame:
    m, out = _mentions(spark, d), None
    for scope, part in (("all", m), ("train", m.where("is_train_used"))):
        one = part.groupBy("entity_group").agg(F.count("*").alias("mentions"), F.count_distinct("normalized_entity").alias("entities"), F.count_distinct("article_id").alias("articles")).select(F.lit(scope).alias("scope"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def top_entities(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent entities of all groups and the 40 of each group, with their raw forms."""
    m = _mentions(spark, d).where("is_train_used")
    t = m.groupBy("entity_group", "normalized_entity").agg(F.count_distinct("article_id").alias("df"), F.array_join(F.sort_array(F.collect_set("raw_entity")), "|").alias("raw_forms"))
    t = Scratch(spark, "top").keep(t)
    w = Window.partitionBy("entity_group").orderBy(F.desc("df"), "normalized_entity")
    own = t.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 40").select(F.lit("group").alias("list"), "*")
    every = t.withColumn("all", F.lit(0)).withColumn("place", F.row_number().over(Window.partitionBy("all").orderBy(F.desc("df"), "normalized_entity", "entity_group")).cast("bigint")).where("place <= 50").drop("all")
    return own.unionByName(every.select(F.lit("all").alias("list"), "*"))


def raw_variants(spark: SparkSession, d: str) -> DataFrame:
    """Entities that are written in more than one raw way."""
    m = _mentions(spark, d)
    return m.groupBy("entity_group", "normalized_entity").agg(F.count_distinct("raw_entity").alias("n_forms"), F.count_distinct("article_id").alias("articles")).where("n_forms > 1")


def df1_fragmentation(spark: SparkSession, d: str) -> DataFrame:
    """Share of entities that stand in one train article only, overall and by group."""
    agg = [F.count("*").alias("entities"), F.count_if(F.col("df") == 1).alias("df1_entities"), F.round(F.count_if(F.col("df") == 1) / F.count("*"), 6).alias("ratio")]
    df = _df(spark, d)
    return df.agg(*agg).select(F.lit("ALL").alias("entity_group"), "*").unionByName(df.groupBy("entity_group").agg(*agg))


def token_containment(spark: SparkSession, d: str) -> DataFrame:
    return E.token_containment(_df(spark, d))


def containment_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Contained surfaces that stand in one article with the longer one, with the first ten articles."""
    p = E.token_containment(_df(spark, d)).select(F.concat("entity_group", F.lit("::"), "short_entity").alias("short_key"), F.concat("entity_group", F.lit("::"), "full_entity").alias("full_key"))
    sets = E.entity_sets(_mentions(spark, d).where("is_train_used"), "baseline_entity_key")
    return E.cooccurrence(p, sets, "short_key", "full_key", 10).where("n_articles > 0")


def cross_type_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces that stand in more than one group."""
    return _df(spark, d).groupBy("entity").agg(F.count("*").alias("n_groups"), F.array_join(F.sort_array(F.collect_list("entity_group")), "|").alias("groups"), F.sum("df").alias("total_df")).where("n_groups > 1")


def type_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many surfaces each pair of groups shares: combinations of a surface's few groups, by array functions."""
    g = _df(spark, d).groupBy("entity").agg(F.sort_array(F.collect_list("entity_group")).alias("g")).where("size(g) > 1")
    pairs = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return g.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n")).select(F.col("a").alias("group_a"), F.col("b").alias("group_b"), F.col("n").alias("n_surfaces"))


def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    """The diagnostics as (metric, value)."""
    m, df = _mentions(spark, d), _df(spark, d)
    row = m.agg(F.count("*").alias("mentions_total"), F.count_if("is_train_used").alias("mentions_train"))
    other = df.agg(F.count("*").alias("entities_train"), F.count_if(F.col("df") == 1).alias("df1_entities"))
    row = row.withColumn("containment_pairs", E.token_containment(df).agg(F.count("*")).scalar())
    row = row.withColumn("possessive_candidates", E.possessive_candidates(df).agg(F.count("*")).scalar())
    pairs = E.token_containment(df)
    sides = pairs.select("entity_group", F.col("short_entity").alias("e")).unionByName(pairs.select("entity_group", F.col("full_entity").alias("e"))).distinct()
    kinds = df.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1")
    for name, n in (("containment_participants", sides), ("containment_shorts", pairs.select("entity_group", "short_entity").distinct()), ("cross_type_surfaces", kinds), ("raw_variant_groups", raw_variants(spark, d)), ("articles_with_mentions", m.select("article_id").distinct())):
        row = row.withColumn(name, n.agg(F.count("*")).scalar())
    return unpivot(row).unionByName(unpivot(other))


def containment_share(spark: SparkSession, d: str) -> DataFrame:
    """Per group, how many surfaces take part in a containment and their share of all surfaces."""
    df = _df(spark, d)
    pairs = E.token_containment(df)
    sides = pairs.select("entity_group", F.col("short_entity").alias("entity")).unionByName(pairs.select("entity_group", F.col("full_entity").alias("entity"))).distinct()
    n = df.groupBy("entity_group").agg(F.count("*").alias("entities"))
    part = sides.groupBy("entity_group").agg(F.count("*").alias("participants"))
    counted = pairs.groupBy("entity_group").agg(F.count("*").alias("pairs"))
    out = n.join(part, "entity_group", "left").join(counted, "entity_group", "left").fillna(0, ["participants", "pairs"])
    return out.withColumn("ratio", F.round(F.col("participants") / F.col("entities"), 6))


def _rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Buckets of the rules over respelled mentions after the possessive map, and the articles of each surface."""
    e = _respelled(spark, d, "v1")
    sets = e.where("is_train_used").select("article_id", "entity_group", F.col("canonical_entity").alias("entity")).distinct()
    return E.rule_buckets(E.surface_statistics(e)), sets


def surface_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Canonical surfaces of train with their articles and mentions."""
    return E.surface_statistics(_entities(spark, d))


def rule_collisions(spark: SparkSession, d: str) -> DataFrame:
    return E.rule_collisions(*_rules(spark, d))


def rule_mappings(spark: SparkSession, d: str) -> DataFrame:
    return E.rule_mappings(*_rules(spark, d))


def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.rule_summary(*_rules(spark, d))


def char_inventory(spark: SparkSession, d: str) -> DataFrame:
    return E.character_inventory(_mentions(spark, d).where("is_train_used")).withColumn("code", F.lower(F.hex(F.encode("ch", "UTF-32"))))


def _aliases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Surfaces of the respelled text after both maps, and the articles each stands in."""
    e = _respelled(spark, d)
    return Scratch(spark, "aliases").keep(E.surface_statistics(e)), e.where("is_train_used").select("article_id", F.col("canonical_entity_key").alias("entity")).distinct()


def _with_evidence(c: DataFrame, sets: DataFrame, variant: str, base: str) -> DataFrame:
    """Candidates with the articles both stand in: how many, their share of the rarer one's, the first five."""
    keyed = c.withColumns({"a": F.concat(F.lit("ORG::"), variant), "b": F.concat(F.lit("ORG::"), base)})
    seen = E.cooccurrence(keyed, sets, "a", "b")
    least = F.least(*[F.col(x) for x in c.columns if x.endswith("_df")])
    return seen.withColumn("overlap_ratio", F.round(F.when(least > 0, F.col("n_articles") / least).otherwise(0.0), 6)).drop("a", "b", "first_article")


def _acronyms(df: DataFrame, sets: DataFrame) -> DataFrame:
    seen = _with_evidence(E.acronym_candidates(df), sets, "short_entity", "long_entity")
    tier = (
        F.when((F.col("n_longs") == 1) & (F.col("n_articles") >= 2) & (F.col("short_df") >= 2), "SAFE")
        .when((F.col("n_longs") == 1) & (F.col("n_articles") >= 1), "STRONG")
        .when(F.col("n_longs") > 1, "AMBIGUOUS")
        .otherwise("WEAK")
    )
    return seen.withColumn("tier", tier)


def acronym_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Acronyms with the articles both stand in, and how safe they are."""
    return _acronyms(*_aliases(spark, d))


def punctuation_candidates(spark: SparkSession, d: str) -> DataFrame:
    df, sets = _aliases(spark, d)
    return _with_evidence(E.punctuation_candidates(df), sets, "variant", "canonical")


def legal_suffix_candidates(spark: SparkSession, d: str) -> DataFrame:
    df, sets = _aliases(spark, d)
    return _with_evidence(E.legal_suffix_candidates(df), sets, "variant", "canonical")


def short_form_candidates(spark: SparkSession, d: str) -> DataFrame:
    df, sets = _aliases(spark, d)
    return _with_evidence(E.short_form_candidates(df), sets, "variant", "base")


def _all_aliases(df: DataFrame) -> DataFrame:
    tier = F.lit("REVIEW").alias("tier")
    n, safe = F.col("n_longs"), F.lit("AMBIGUOUS")
    parts = [
        E.acronym_candidates(df).select(F.lit("acronym").alias("rule"), F.col("short_entity").alias("variant"), F.col("long_entity").alias("candidate"), F.when(n > 1, safe).otherwise("UNIQUE").alias("tier")),
        E.punctuation_candidates(df).select(F.lit("punctuation").alias("rule"), "variant", F.col("canonical").alias("candidate"), "tier"),
        E.legal_suffix_candidates(df).select(F.lit("legal_suffix").alias("rule"), "variant", F.col("canonical").alias("candidate"), "tier"),
        E.short_form_candidates(df).select(F.lit("short_form").alias("rule"), "variant", F.col("base").alias("candidate"), tier),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["rule", "variant", "candidate"])


def v3_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All inspected alias candidates of organisations, distinct by rule and pair, counted by rule and tier."""
    return _all_aliases(_aliases(spark, d)[0]).groupBy("rule", "tier").agg(F.count("*").alias("n_candidates"), F.count_distinct("variant").alias("n_variants"))


def v3_top_examples(spark: SparkSession, d: str) -> DataFrame:
    """The twenty alias candidates of each rule that stand in one article most often; the limit is the feature."""
    df, sets = _aliases(spark, d)
    c = _all_aliases(df).withColumns({"a": F.concat(F.lit("ORG::"), "variant"), "b": F.concat(F.lit("ORG::"), "candidate")})
    seen = E.cooccurrence(c, sets, "a", "b").select("rule", "variant", "candidate", "n_articles")
    w = Window.partitionBy("rule").orderBy(F.desc("n_articles"), "variant", "candidate")
    return seen.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 20")


_names = (
    "mentions possessive_map possessive_candidates hyphen_map article_entities normalization_stats entity_sets list_mismatch entity_group_stats top_entities raw_variants df1_fragmentation "
    "token_containment containment_cooccurrence cross_type_surfaces type_pair_counts entity_summary containment_share surface_statistics rule_collisions rule_mappings rule_summary char_inventory acronym_candidates punctuation_candidates "
    "legal_suffix_candidates short_form_candidates v3_candidates v3_top_examples"
).split()
QUERIES = {n: globals()[n] for n in _names}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DASH = lambda x: f"translate({x}, {_q(E.DASHES)}, {_q('-' * len(E.DASHES))})"
_TIDY = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ')"


def chain_sql(p: str, source: str) -> str:
    """CTEs from a mention table to canonical mentions, each name with the prefix ``p``: sdf surfaces, pos / hyp maps, ae canonical mentions, es distinct (article, key), bs keys before."""
    spaced = _TIDY(f"replace({_DASH('v.entity')}, '-', ' ')")
    return f""",
{p}sdf as materialized (select entity_group, normalized_entity entity, count(distinct article_id) df from {source} where is_train_used group by 1, 2),
{p}posc as (select v.entity_group, v.entity variant_entity, v.df variant_df, b.entity base_entity, b.df base_df from {p}sdf v join {p}sdf b on v.entity_group = b.entity_group and v.entity = b.entity || 's'),
{p}pos as materialized (select * from {p}posc where entity_group in ('PER', 'ORG', 'LOC') and length(base_entity) >= 3 and base_df >= 2 and base_df >= variant_df and (entity_group <> 'PER' or contains(base_entity, ' '))),
{p}m2 as materialized (select k.*, {p}pos.base_entity possessive, coalesce({p}pos.base_entity, k.normalized_entity) first_form from {source} k left join {p}pos on {p}pos.entity_group = k.entity_group and {p}pos.variant_entity = k.normalized_entity),
{p}s2 as materialized (select distinct entity_group, first_form entity from {p}m2 where is_train_used),
{p}hyp as materialized (select v.entity_group, v.entity variant_entity, {spaced} base_entity from {p}s2 v
  where {spaced} <> v.entity and not starts_with({_DASH('v.entity')}, '-') and not ends_with({_DASH('v.entity')}, '-')
  and exists (select 1 from {p}s2 t where t.entity_group = v.entity_group and t.entity = {spaced})),
{p}ae as materialized (select k.*, coalesce(h.base_entity, first_form) canonical_entity, k.entity_group || '::' || coalesce(h.base_entity, first_form) canonical_entity_key,
  case when possessive is not null and h.base_entity is not null then 'safe_possessive_v1+safe_hyphen_v2' when possessive is not null then 'safe_possessive_v1' when h.base_entity is not null then 'safe_hyphen_v2' else 'baseline' end processing_method
  from {p}m2 k left join {p}hyp h on h.entity_group = k.entity_group and h.variant_entity = k.first_form),
{p}es as materialized (select distinct article_id, canonical_entity_key entity from {p}ae),
{p}bs as materialized (select distinct article_id, baseline_entity_key entity from {source} where is_train_used)"""


#: More shared CTEs: m mentions and what ``chain_sql`` makes of them.
WITH = CATALOG + f""",
m0 as (select article_id, i - 1 entity_position, ner_clusters[i] raw_entity, entity_groups[i] raw_entity_group from (select *, unnest(range(1, len(ner_clusters) + 1)) i from va)),
m1 as materialized (select *, {entity_text_sql('raw_entity')} normalized_entity, {entity_group_sql('raw_entity_group')} entity_group from m0 where raw_entity is not null and raw_entity_group is not null),
m as materialized (select m1.*, entity_group || '::' || normalized_entity baseline_entity_key, article_id in (select article_id from tu) is_train_used from m1 where normalized_entity <> '' and entity_group <> '')""" + chain_sql("", "m") + """,
tc as (select s.entity_group, s.entity short_entity, s.df short_df, f.entity full_entity, f.df full_df from sdf s join (select *, unnest(list_distinct(string_split(entity, ' '))) tok from sdf where contains(entity, ' ')) f
  on f.entity_group = s.entity_group and f.tok = s.entity where not contains(s.entity, ' '))
"""
#: Respelled mentions (rm) and their chain (r_), surfaces after the possessive map (v1) and after both (v2) with their articles.
RESPELLED = WITH + """,
rm as materialized (select * replace (case when article_id % 7 = 0 and contains(normalized_entity, ' ') then replace(normalized_entity, ' ', '-') when article_id % 7 = 1 then normalized_entity || 's'
    when entity_group <> 'ORG' then normalized_entity when article_id % 7 = 2 then normalized_entity || ' a/s'
    when article_id % 7 = 3 and contains(normalized_entity, ' ') then array_to_string(list_transform(string_split(normalized_entity, ' '), lambda x: left(x, 1)), '')
    when article_id % 7 = 4 then replace(normalized_entity, ' ', '. ') when article_id % 7 = 5 then normalized_entity || ' gruppen' else normalized_entity end as normalized_entity) from m),
rn as materialized (select * replace (entity_group || '::' || normalized_entity as baseline_entity_key) from rm)""" + chain_sql("r_", "rn") + """,
v1 as materialized (select entity_group, first_form entity, count(distinct article_id) df, count(*) mentions from r_m2 where is_train_used group by 1, 2),
v1s as materialized (select distinct article_id, entity_group, first_form entity from r_m2 where is_train_used),
v2 as materialized (select entity_group, canonical_entity entity, count(distinct article_id) df, count(*) mentions from r_ae where is_train_used group by 1, 2),
v2s as materialized (select distinct article_id, canonical_entity_key entity from r_ae where is_train_used)
"""
_APOS = lambda x: f"translate({x}, {_q(E.APOSTROPHES)}, {_q(chr(39) * len(E.APOSTROPHES))})"
_DQ = lambda x: f"translate({x}, {_q(E.DOUBLE_QUOTES)}, {_q(chr(34) * len(E.DOUBLE_QUOTES))})"
_UNQ = _TIDY(_DQ(_APOS("entity")))
_RULES = {
    "zero_width": _TIDY(f"translate(entity, {_q(E.ZERO_WIDTH)}, '')"),
    "apostrophe": _TIDY(_APOS("entity")),
    "double_quote": _TIDY(_DQ("entity")),
    "dash": _TIDY(_DASH("entity")),
    "hyphen_spacing": _TIDY(f"regexp_replace({_DASH('entity')}, '\\s*-\\s*', '-', 'g')"),
    "hyphen_vs_space": _TIDY(f"regexp_replace({_DASH('entity')}, '\\s*-\\s*', ' ', 'g')"),
    "outer_quotes": _TIDY(f"""case when length({_UNQ}) >= 2 and left({_UNQ}, 1) in ('"', '''') and left({_UNQ}, 1) = right({_UNQ}, 1) then substr({_UNQ}, 2, length({_UNQ}) - 2) else {_UNQ} end"""),
    "terminal_punctuation": _TIDY(f"regexp_replace({_TIDY('entity')}, '[.,;:!?]+$', '')"),
}
_TOK = lambda x: rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+')"
_quoted = lambda words: ", ".join(_q(x) for x in words)
_BUCKETS = ", st as (" + " union all ".join(f"select '{n}' rule, entity_group, entity, df, mentions, {e} canonical from v1" for n, e in _RULES.items()) + """),
bk as materialized (select * from (select *, count(*) over p n, bool_or(entity <> canonical) over p changed from st where canonical <> '' window p as (partition by rule, entity_group, canonical)) where n > 1 and changed)
"""
_SIG = f"list_filter({_TOK('entity')}, lambda x: x not in ({_quoted(E.ALIAS_STOP_WORDS)}))"
_INITIALS = f"array_to_string(list_transform({_SIG}, lambda x: left(x, 1)), '')"
_EXPANDED = f"array_to_string(list_transform({_SIG}, lambda x: case when x in ({_quoted(E.WHOLE_WORDS)}) then x else left(x, 1) end), '')"
_ONE_WORD = f"array_to_string({_TOK('entity')}, '')"
_ACRONYMS = f"""(select *, count(*) over (partition by short_entity) n_longs from (select l.entity long_entity, l.df long_df, s.entity short_entity, s.df short_df, l.sg signature
  from (select entity, df, sg from (select *, {_INITIALS} sg from v2 where entity_group = 'ORG' and len({_SIG}) >= 2 union select *, {_EXPANDED} from v2 where entity_group = 'ORG' and len({_SIG}) >= 2) where length(sg) between 2 and 8) l
  join (select *, {_ONE_WORD} sg from v2 where entity_group = 'ORG' and len({_TOK('entity')}) = 1) s on s.sg = l.sg and length(s.sg) between 2 and 8 where s.entity <> l.entity))"""
_COLLAPSED = f"""array_to_string(list_transform({_TOK('entity')}, lambda x, i: case when i = 1 or (regexp_matches(x, '^\\p{{L}}$') and regexp_matches({_TOK('entity')}[i - 1], '^\\p{{L}}$')) then x else ' ' || x end), '')"""
_PUNCT = f"""(select signature, group_size, case when b.df > a.df then a.entity else b.entity end variant, case when b.df > a.df then b.entity else a.entity end canonical, least(a.df, b.df) variant_df, greatest(a.df, b.df) canonical_df,
  case when group_size = 2 and greatest(a.df, b.df) >= 2 then 'SAFE' else 'REVIEW' end tier
  from (select *, {_COLLAPSED} signature, count(*) over (partition by {_COLLAPSED}) group_size from v2 where entity_group = 'ORG') a
  join (select *, {_COLLAPSED} signature from v2 where entity_group = 'ORG') b using (signature) where a.entity < b.entity and signature <> '')"""
_LEGAL = f"""(select v.entity variant, b.entity canonical, v.df variant_df, b.df canonical_df, case when b.df >= 2 and b.df >= v.df then 'SAFE' else 'REVIEW' end tier
  from (select *, regexp_extract(array_to_string({_TOK('entity')}, ' '), {_q('^(.+?) (?:' + '|'.join(sorted(map(' '.join, E.LEGAL_SUFFIXES), key=lambda x: (-len(x), x))) + ')$')}, 1) base from v2 where entity_group = 'ORG') v
  join (select *, array_to_string({_TOK('entity')}, ' ') words from v2 where entity_group = 'ORG') b on v.base = b.words where v.base <> '' and v.entity <> b.entity)"""
_SHORT = """(select v.entity variant, b.entity base, cut, v.df variant_df, b.df base_df from (
  select entity, df, 'prefix1' cut, array_to_string(string_split(entity, ' ')[2:], ' ') base, len(string_split(entity, ' ')) > 1 ok from v2 where entity_group = 'ORG'
  union all select entity, df, 'prefix2', array_to_string(string_split(entity, ' ')[3:], ' '), len(string_split(entity, ' ')) > 2 from v2 where entity_group = 'ORG'
  union all select entity, df, 'suffix1', array_to_string(string_split(entity, ' ')[:-2], ' '), len(string_split(entity, ' ')) > 1 from v2 where entity_group = 'ORG'
  union all select entity, df, 'suffix2', array_to_string(string_split(entity, ' ')[:-3], ' '), len(string_split(entity, ' ')) > 2 from v2 where entity_group = 'ORG') v
  join v2 b on b.entity_group = 'ORG' and b.entity = v.base where v.ok and length(v.base) >= 5)"""


def _evidence_sql(source: str, variant: str, base: str, dfs: tuple[str, str]) -> str:
    """Rows of ``source`` with the articles both names stand in."""
    return f"""(select *, round(case when least({dfs[0]}, {dfs[1]}) > 0 then n_articles / least({dfs[0]}, {dfs[1]}) else 0.0 end, 6) overlap_ratio from (
  select c.*, coalesce(x.n, 0) n_articles, x.ids example_ids from {source} c left join (select p.v, p.b, count(*) n, array_to_string(list_sort(list(i.article_id))[1:5], ',') ids
    from (select distinct {variant} v, {base} b from {source}) p join v2s i on i.entity = 'ORG::' || p.v join v2s j on j.entity = 'ORG::' || p.b and j.article_id = i.article_id group by 1, 2) x on x.v = c.{variant} and x.b = c.{base}))"""


_ALIASES = f"""(select 'acronym' rule, short_entity variant, long_entity candidate, max(case when n_longs > 1 then 'AMBIGUOUS' else 'UNIQUE' end) tier from {_ACRONYMS} group by 1, 2, 3 union all select distinct 'punctuation', variant, canonical, tier from {_PUNCT}
  union all select distinct 'legal_suffix', variant, canonical, tier from {_LEGAL} union all select distinct 'short_form', variant, base, 'REVIEW' from {_SHORT})"""
_D1 = "count(*) entities, count(*) filter (df = 1) df1_entities, round(count(*) filter (df = 1) / count(*), 6) ratio from sdf"
SQL = {
    "mentions": WITH + "select article_id, entity_position, raw_entity, raw_entity_group, normalized_entity, entity_group, baseline_entity_key, is_train_used from m",
    "possessive_map": WITH + "select * from pos",
    "possessive_candidates": WITH + "select * from posc where length(variant_entity) > 2",
    "hyphen_map": RESPELLED + "select * from r_hyp",
    "article_entities": WITH + "select article_id, entity_position, baseline_entity_key, canonical_entity_key, processing_method, is_train_used from ae",
    "normalization_stats": WITH + """select count(*) n_mentions, count(*) filter (baseline_entity_key <> canonical_entity_key) changed_mentions, count(distinct article_id) filter (baseline_entity_key <> canonical_entity_key) changed_articles,
  (select count(*) from (select distinct article_id, baseline_entity_key from ae)) pairs_before, (select count(*) from es) pairs_after from ae""",
    "entity_sets": WITH + "select article_id, count(*) n_entities, string_agg(entity, '|' order by entity) entities from es group by 1",
    "list_mismatch": "select count(*) filter (ner_clusters is null) null_lists, count(*) filter (len(ner_clusters) = 0) empty_lists, count(*) filter (coalesce(len(ner_clusters), 0) <> coalesce(len(entity_groups), 0)) mismatched from articles",
    "entity_group_stats": WITH + """select 'all' scope, entity_group, count(*) mentions, count(distinct normalized_entity) entities, count(distinct article_id) articles from m group by 2
  union all select 'train', entity_group, count(*), count(distinct normalized_entity), count(distinct article_id) from m where is_train_used group by 2""",
    "top_entities": WITH + """, tp as materialized (select entity_group, normalized_entity, count(distinct article_id) df, string_agg(distinct raw_entity, '|' order by raw_entity) raw_forms from m where is_train_used group by 1, 2)
  select * from (select 'group' list, *, row_number() over (partition by entity_group order by df desc, normalized_entity) place from tp) where place <= 40
  union all select * from (select 'all', *, row_number() over (order by df desc, normalized_entity, entity_group) place from tp) where place <= 50""",
    "raw_variants": WITH + "select entity_group, normalized_entity, count(distinct raw_entity) n_forms, count(distinct article_id) articles from m group by 1, 2 having count(distinct raw_entity) > 1",
    "df1_fragmentation": WITH + f"select 'ALL' entity_group, {_D1} union all select entity_group, {_D1} group by entity_group",
    "token_containment": WITH + "select * from tc",
    "containment_cooccurrence": WITH + """select entity_group || '::' || short_entity short_key, entity_group || '::' || full_entity full_key, count(*) n_articles, min(x.article_id) first_article, array_to_string(list_sort(list(x.article_id))[1:10], ',') example_ids
  from tc join bs x on x.entity = entity_group || '::' || short_entity join bs y on y.article_id = x.article_id and y.entity = entity_group || '::' || full_entity group by 1, 2""",
    "cross_type_surfaces": WITH + "select entity, count(*) n_groups, string_agg(entity_group, '|' order by entity_group) groups, cast(sum(df) as bigint) total_df from sdf group by 1 having count(*) > 1",
    "type_pair_counts": WITH + "select a.entity_group group_a, b.entity_group group_b, count(*) n_surfaces from sdf a join sdf b on a.entity = b.entity and a.entity_group < b.entity_group group by 1, 2",
    "entity_summary": WITH + """select 'mentions_total' metric, count(*) \"value\" from m union all select 'mentions_train', count(*) from m where is_train_used union all select 'entities_train', count(*) from sdf
  union all select 'df1_entities', count(*) from sdf where df = 1 union all select 'containment_pairs', count(*) from tc union all select 'possessive_candidates', count(*) from posc
  union all select 'containment_participants', count(*) from (select entity_group, short_entity from tc union select entity_group, full_entity from tc) union all select 'containment_shorts', count(*) from (select distinct entity_group, short_entity from tc)
  union all select 'cross_type_surfaces', count(*) from (select entity from sdf group by 1 having count(*) > 1) union all select 'raw_variant_groups', count(*) from (select 1 from m group by entity_group, normalized_entity having count(distinct raw_entity) > 1)
  union all select 'articles_with_mentions', count(distinct article_id) from m""",
    "containment_share": WITH + """select entity_group, entities, coalesce(p, 0) participants, coalesce(n, 0) pairs, round(coalesce(p, 0) / entities, 6) ratio from (select entity_group, count(*) entities from sdf group by 1)
  left join (select entity_group, count(*) p from (select entity_group, short_entity e from tc union select entity_group, full_entity from tc) group by 1) using (entity_group) left join (select entity_group, count(*) n from tc group by 1) using (entity_group)""",
    "surface_statistics": WITH + "select entity_group, canonical_entity entity, count(distinct article_id) df, count(*) mentions from ae where is_train_used group by 1, 2",
    "rule_collisions": RESPELLED + _BUCKETS + """select b.rule, b.entity_group, b.canonical, bool_or(b.entity = b.canonical) observed, count(*) surface_count, string_agg(b.entity, '|' order by df desc, mentions desc, b.entity) surfaces,
  string_agg(cast(df as varchar), '|' order by df desc, mentions desc, b.entity) surface_dfs, string_agg(cast(mentions as varchar), '|' order by df desc, mentions desc, b.entity) surface_mentions,
  any_value(u.n) union_df from bk b join (select rule, entity_group, canonical, count(distinct article_id) n from bk join v1s using (entity_group, entity) group by 1, 2, 3) u using (rule, entity_group, canonical) group by 1, 2, 3""",
    "rule_mappings": RESPELLED + _BUCKETS + """select b.rule, b.entity_group, b.entity variant, b.canonical, b.df variant_df, coalesce(c.df, 0) canonical_df, c.df is not null observed,
  (select count(*) from v1s x join v1s y using (article_id) where x.entity_group = b.entity_group and y.entity_group = b.entity_group and x.entity = b.entity and y.entity = b.canonical) cooccurrence
  from bk b left join v1 c on c.entity_group = b.entity_group and c.entity = b.canonical where b.entity <> b.canonical""",
    "rule_summary": RESPELLED + _BUCKETS + """select rule, count(distinct (entity_group, canonical)) collision_groups, count(distinct (entity_group, canonical, entity)) filter (entity <> canonical) mapping_candidates, count(distinct article_id) affected_articles
  from bk join v1s using (entity_group, entity) group by 1""",
    "char_inventory": WITH + r"""select ch, format('{:08x}', unicode(ch)) code, count(*) occurrences, count(distinct article_id) articles, count(distinct normalized_entity) surfaces from (
  select article_id, normalized_entity, unnest(string_split(normalized_entity, '')) ch from m where is_train_used) where regexp_matches(ch, '^[\p{P}\p{Cf}]$') group by 1""",
    "acronym_candidates": RESPELLED + "select *, case when n_longs = 1 and n_articles >= 2 and short_df >= 2 then 'SAFE' when n_longs = 1 and n_articles >= 1 then 'STRONG' when n_longs > 1 then 'AMBIGUOUS' else 'WEAK' end tier from "
    + _evidence_sql(_ACRONYMS, "short_entity", "long_entity", ("short_df", "long_df")),
    "punctuation_candidates": RESPELLED + "select * from " + _evidence_sql(_PUNCT, "variant", "canonical", ("variant_df", "canonical_df")),
    "legal_suffix_candidates": RESPELLED + "select * from " + _evidence_sql(_LEGAL, "variant", "canonical", ("variant_df", "canonical_df")),
    "short_form_candidates": RESPELLED + "select * from " + _evidence_sql(_SHORT, "variant", "base", ("variant_df", "base_df")),
    "v3_candidates": RESPELLED + f"select rule, tier, count(*) n_candidates, count(distinct variant) n_variants from {_ALIASES} group by 1, 2",
    "v3_top_examples": RESPELLED + f"""select rule, variant, candidate, n_articles, place from (select *, row_number() over (partition by rule order by n_articles desc, variant, candidate) place from (
  select rule, variant, candidate, (select count(*) from v2s x join v2s y using (article_id) where x.entity = 'ORG::' || variant and y.entity = 'ORG::' || candidate) n_articles from {_ALIASES})) where place <= 20""",
}
