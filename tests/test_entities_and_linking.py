"""Normalisation guards, rules, linking decisions, sampling, records, vectors, exports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newsloom.operators import catalog as C
from newsloom.operators import entities as E
from newsloom.operators import export, linking, search, vectors
from newsloom.operators.sampling import diverse_sample
from newsloom.plans import linking_queries
from newsloom.runtime import Scratch
from newsloom.sources import records
from newsloom.streaming.twins import session_counts

DF = "entity_group string, entity string, df bigint"


def test_valid_articles(spark):
    t = dt.datetime(2016, 1, 1)
    schema = "article_id int, title string, subtitle string, published_time timestamp_ntz, ner_clusters array<string>, entity_groups array<string>, category_str string"
    rows = [
        (1, " T ", "S", t, ["a"], ["PER"], "x"), (2, "T", " ", t, None, None, " "), (3, None, "S", t, [], None, None), (4, " ", None, t, [], [], "x"), (5, "T", None, None, [], [], "x"),
        (6, "T", None, t, ["a"], [], "x"), (7, "T", None, t, [], [], "x"), (7, "T", None, t, [], [], "x"), (None, "T", None, t, [], [], "x"),
    ]
    good = C.valid_articles(spark.createDataFrame(rows, schema))
    assert {r["article_id"]: r["model_text"] for r in good.collect()} == {1: "query: T\nS", 2: "query: T", 3: "query: S"}
    mapping = C.category_mapping(good)
    assert {tuple(r) for r in mapping.collect()} == {("<UNK>", 0), ("x", 1)}
    assert {r["article_id"]: r["model_category_id"] for r in C.with_category(good, mapping).collect()} == {1: 1, 2: 0, 3: 0}


def test_possessive_guards(spark):
    df = spark.createDataFrame([("PER", "ab c", 2), ("PER", "ab cs", 2), ("PER", "solo", 5), ("PER", "solos", 1), ("ORG", "org", 1), ("ORG", "orgs", 1), ("LOC", "by", 9), ("LOC", "bys", 1), ("LOC", "land", 2), ("LOC", "lands", 3), ("MISC", "cup", 5), ("MISC", "cups", 1)], DF)
    c = E.possessive_candidates(df)
    assert c.count() == 6
    assert [r["base_entity"] for r in E.safe_possessive(c).collect()] == ["ab c"]


def test_hyphen_guards(spark):
    s = spark.createDataFrame([("ORG", "a-b"), ("ORG", "a b"), ("ORG", "c–d"), ("ORG", "-x y"), ("ORG", "x y"), ("PER", "a b")], "entity_group string, entity string")
    assert [(r["variant_entity"], r["base_entity"]) for r in E.hyphen_map(s).collect()] == [("a-b", "a b")]


def test_mentions_keep_the_raw_position(spark):
    a = spark.createDataFrame([(1, ["X", " ", None, "Y"], ["PER", "PER", "PER", "org "]), (2, None, None)], "article_id bigint, ner_clusters array<string>, entity_groups array<string>")
    m = E.mentions(a, spark.createDataFrame([(1,)], "article_id bigint"))
    assert sorted((r["entity_position"], r["baseline_entity_key"]) for r in m.collect()) == [(0, "PER::x"), (3, "ORG::y")]
    assert E.article_entities(m, "baseline").count() == 2
    with pytest.raises(ValueError):
        E.article_entities(m, "normalize_and_link")


def test_rules(spark):
    df = spark.createDataFrame([("‘a’",), ("b - c",), ('"q"',), ("z.!",), ("w​x",)], "entity string")
    r = [x.asDict() for x in df.select(*[e.alias(n) for n, e in E.rule_transforms(F.col("entity")).items()]).collect()]
    assert r[0]["apostrophe"] == "'a'" and r[0]["outer_quotes"] == "a"
    assert r[1]["hyphen_spacing"] == "b-c" and r[1]["hyphen_vs_space"] == "b c"
    assert r[2]["outer_quotes"] == "q" and r[3]["terminal_punctuation"] == "z" and r[4]["zero_width"] == "wx"


def test_acronyms_and_suffixes(spark):
    df = spark.createDataFrame([("ORG", "danmarks radio", 3), ("ORG", "dr", 2), ("ORG", "novo a/s", 1), ("ORG", "novo", 2), ("ORG", "a.b", 1), ("ORG", "ab", 3), ("ORG", "manchester united fc", 1), ("ORG", "manchester united", 4)], DF)
    assert [(r["short_entity"], r["long_entity"]) for r in E.acronym_candidates(df).collect()] == [("dr", "danmarks radio")]
    assert [(r["variant"], r["canonical"], r["tier"]) for r in E.legal_suffix_candidates(df).collect()] == [("novo a/s", "novo", "SAFE")]
    assert [(r["variant"], r["canonical"]) for r in E.punctuation_candidates(df).collect()] == [("a.b", "ab")]
    assert ("manchester united fc", "manchester united") in {(r["variant"], r["base"]) for r in E.short_form_candidates(df).collect()}


@pytest.mark.parametrize(("name", "signatures", "short"), [
    ("den danske bank", ["db"], "dendb"), ("dansk el forbund", ["def"], "delf"), ("fc københavn", ["fk", "fck"], "fck"), ("european union", ["eu"], "eu"), ("bank", [], None), ("og i", [], None),
    ("a.p. møller", ["pm"], "apm"), ("tv2 danmark", ["td"], "td"), ("112 alarm", ["1a"], "112a"), ("a b c d e f g h k l m", [], "bcdefghklm"),
])
def test_acronyms_of_a_name(spark, name, signatures, short):
    r = spark.createDataFrame([(name,)], "n string").select(E.acronym_signatures(F.col("n")).alias("s"), E.link_acronym(F.col("n")).alias("l")).first()
    assert (r["s"], r["l"]) == (signatures, short)


def test_punctuation_is_a_matter_of_words(spark):
    df = spark.createDataFrame([("ORG", x, n) for x, n in (("ab c", 5), ("abc", 4), ("a.b.c", 1), ("a b c", 4), ("f.c. nord", 2), ("fc nord", 2), ("fc-nord", 1), ("1 2", 1), ("12", 1))] + [("PER", "f c nord", 9)], DF)
    got = {(r["variant"], r["canonical"], r["group_size"], r["tier"]) for r in E.punctuation_candidates(df).collect()}
    assert got == {
        ("a.b.c", "a b c", 3, "REVIEW"), ("a.b.c", "abc", 3, "REVIEW"), ("abc", "a b c", 3, "REVIEW"), ("fc-nord", "f.c. nord", 3, "REVIEW"), ("fc-nord", "fc nord", 3, "REVIEW"), ("fc nord", "f.c. nord", 3, "REVIEW"),
    }
    two = spark.createDataFrame([("ORG", "a.b", 1), ("ORG", "ab", 3), ("ORG", "x-y z", 1), ("ORG", "x.y z", 1)], DF)
    assert {(r["variant"], r["canonical"], r["tier"]) for r in E.punctuation_candidates(two).collect()} == {("a.b", "ab", "SAFE"), ("x.y z", "x-y z", "REVIEW")}


def test_rules_map_changed_surfaces_to_the_rewritten_text(spark):
    rows = [(1, "LOC", "a–b"), (2, "LOC", "a–b"), (2, "LOC", "a-b"), (3, "LOC", "a—b"), (3, "LOC", "a—b"), (4, "LOC", "c–d"), (5, "LOC", "z")]
    e = spark.createDataFrame([(*r, True) for r in rows] + [(9, "LOC", "a−b", False)], "article_id bigint, entity_group string, canonical_entity string, is_train_used boolean")
    stats = E.surface_statistics(e)
    assert {(r["entity"], r["df"], r["mentions"]) for r in stats.collect()} == {("a–b", 2, 2), ("a-b", 1, 1), ("a—b", 1, 2), ("c–d", 1, 1), ("z", 1, 1)}
    sets = e.where("is_train_used").selectExpr("article_id", "entity_group", "canonical_entity entity").distinct()
    b = E.rule_buckets(stats)
    got = E.rule_collisions(b, sets).where("rule = 'dash'").first()
    assert (got["canonical"], got["observed"], got["surfaces"], got["surface_dfs"], got["surface_mentions"], got["union_df"]) == ("a-b", True, "a–b|a—b|a-b", "2|1|1", "2|2|1", 3)
    maps = {(r["variant"], r["canonical"], r["variant_df"], r["canonical_df"], r["observed"], r["cooccurrence"]) for r in E.rule_mappings(b, sets).where("rule = 'dash'").collect()}
    assert maps == {("a–b", "a-b", 2, 1, True, 1), ("a—b", "a-b", 1, 1, True, 0)}
    unseen = E.rule_mappings(E.rule_buckets(stats.where("entity <> 'a-b'")), sets.where("entity <> 'a-b'")).where("rule = 'dash'")
    assert {(r["canonical_df"], r["observed"], r["cooccurrence"]) for r in unseen.collect()} == {(0, False, 0)}
    assert E.rule_summary(b, sets).where("rule = 'dash'").first()["affected_articles"] == 3


def test_context_tokens_fold_case(spark):
    df = spark.createDataFrame([(1, "STRASSE Straße ﬁlm Ａrla ΟΔΟΣ", None, "x_y og")], "article_id int, title string, subtitle string, body string")
    assert set(linking_queries._article_tokens(df).first()["article_tokens"]) == {"strasse", "film", "arla", "οδοσ"}


D = "article_id bigint, canonical_entity_key string, decision string, selected_qid string, confidence string, reason string"


def test_decisions(spark):
    m = spark.createDataFrame([(1, "k"), (1, "k"), (2, "k"), (3, "l"), (4, "k"), (5, "k"), (6, "k"), (7, "k")], "article_id bigint, canonical_entity_key string")
    c = spark.createDataFrame([("k", "Q1"), ("k", "Q2")], "canonical_entity_key string, qid string")
    say = lambda i, k, d, q: (i, k, d, q, "HIGH", "r")
    given = [say(1, "k", "LINKED", "Q1"), say(2, "k", "LINKED", "Q9"), say(3, "l", "LINKED", "Q1"), say(4, "k", "LINKED", "Q1"), say(4, "k", "LINKED", "Q2"), say(6, "k", "UNLINKED", "Q1"), say(7, "k", "UNLINKED", ""), say(9, "z", "LINKED", "Q1")]
    again = [say(2, "k", "LINKED", "Q2"), say(4, "k", "LINKED", "Q7"), say(1, "k", "UNLINKED", None)]
    got = {r["article_id"]: (r["linked_entity_key"], r["resolution_source"], r["reason"]) for r in search.resolved(m, c, spark.createDataFrame(given, D), spark.createDataFrame(again, D)).collect()}
    assert got == {
        1: ("WD::Q1", "DECISION", "r"), 2: ("WD::Q2", "REPAIR", "r"), 3: ("l", "NO_CANDIDATE", "no candidate"), 4: ("k", "FALLBACK", "repeated decision"), 5: ("k", "FALLBACK", "missing decision"), 6: ("k", "FALLBACK", "id without a link"), 7: ("k", "DECISION", "r"),
    }
    assert search.resolved(m.limit(0), c, spark.createDataFrame([], D), spark.createDataFrame([], D)).isEmpty()


HITS = "entity_group string, canonical_entity string, canonical_entity_key string, language string, rank bigint, qid string, label string, description string, match_text string"


def test_hits_of_two_languages(spark):
    hit = lambda lang, rank, q: ("PER", "a", "PER::a", lang, rank, q, f"{q} {lang}", None, f"{q} {lang}")
    hits = spark.createDataFrame([hit("en", 1, "Q2"), hit("en", 2, "Q1"), hit("da", 1, "Q1"), hit("da", 3, "Q3"), hit("da", 3, "Q3"), hit("sv", 1, "Q4")], HITS)
    assert [(r["qid"], r["search_language"]) for r in search.first_seen(hits).orderBy("candidate_rank").collect()] == [("Q1", "da"), ("Q3", "da"), ("Q2", "en"), ("Q4", "sv")]
    both = search.merged(hits, most=3).orderBy("candidate_index").collect()
    assert [(r["qid"], r["best_rank"], r["languages"], r["label"], r["matched_texts"]) for r in both] == [("Q1", 1, "da,en", "Q1 da", ["Q1 da", "Q1 en"]), ("Q2", 1, "en", "Q2 en", ["Q2 en"]), ("Q4", 1, "sv", "Q4 sv", ["Q4 sv"])]
    u = spark.createDataFrame([("PER", "a", "PER::a", 1, 1), ("PER", "b", "PER::b", 1, 1), ("PER", "c", "PER::c", 1, 1)], "entity_group string, canonical_entity string, canonical_entity_key string, article_df int, mention_count int")
    st = search.search_status(u, search.first_seen(hits), u.where("canonical_entity = 'c'"))
    assert {(r["canonical_entity"], r["status"], r["candidate_count"]) for r in st.collect()} == {("a", "FOUND", 4), ("b", "NO_CANDIDATE", 0), ("c", "ERROR", 0)}


def test_cached_searches_and_records(spark, tmp_path):
    result = lambda q, t: {"id": q, "label": f"l{q}", "description": "", "match": {"text": t}}
    line = {"entity_group": "PER", "canonical_entity": "a", "canonical_entity_key": "PER::a", "searches": [{"language": "da", "results": [result("Q2", "a"), result("P9", "x")]}, {"language": "en", "results": [result("Q2", "b"), result("Q3", "a")]}, {"language": "sv", "results": []}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(line) + "\nbroken\n")
    cache = records.read_cache(spark, str(tmp_path), records.SEARCH_CACHE, "canonical_entity_key")
    hits = search.hits_of(cache)
    assert sorted((r["language"], r["rank"], r["qid"], r["match_text"]) for r in hits.collect()) == [("da", 1, "Q2", "a"), ("en", 1, "Q2", "b"), ("en", 2, "Q3", "a")]
    assert [r["qid"] for r in search.first_seen(hits).orderBy("candidate_rank").collect()] == ["Q2", "Q3"]
    claim = lambda q: {"mainsnak": {"datavalue": {"value": {"id": q}}}}
    payload = json.dumps({"id": "Q2", "labels": {"en": {"value": "N"}}, "descriptions": {"da": {"value": "d"}}, "claims": {"P31": [claim("Q5")], "P279": [claim("Q7"), {}]}})
    df = spark.createDataFrame([(payload,), (json.dumps({"id": "Q8", "missing": ""}),), (None,)], "p string")
    got = [r[0].asDict() for r in df.select(records.entity_record(F.col("p"))).collect()]
    assert got[0] == {"qid": "Q2", "missing": False, "label_da": None, "label_en": "N", "description_da": "d", "description_en": None, "label": "N", "p31": ["Q5"], "p279": ["Q7"]}
    assert (got[1]["missing"], got[1]["label"], got[2]["qid"]) == (True, "Q8", None)


def test_soft_types_and_columns(spark):
    rows = [("PER", ["Q5"], ["human"]), ("PER", ["Q1"], ["x"]), ("ORG", ["Q1"], ["Football Club"]), ("ORG", ["Q1"], ["thing"]), ("LOC", [], ["island"]), ("MISC", ["Q1"], ["x"]), ("ORG", [], []), ("LOC", None, None)]
    df = spark.createDataFrame(rows, "g string, i array<string>, c array<string>")
    assert [r[0] for r in df.select(search.soft_type(F.col("g"), F.col("i"), F.col("c"))).collect()] == ["TYPE_MATCH", "TYPE_MISMATCH", "TYPE_MATCH", "TYPE_UNKNOWN", "TYPE_MATCH", "TYPE_UNCHECKED", "TYPE_UNKNOWN", "TYPE_UNKNOWN"]
    wanted = {"id": ("article_id", "id"), "title": ("title",), "body": ("body", "text")}
    assert search.resolve_columns(["ID", "Title", "t"], wanted, {"body": "t"}) == {"id": "ID", "title": "Title", "body": "t"}
    assert search.resolve_columns(["id", "title"], wanted, optional=("body",))["body"] is None
    for columns, given in ((["id", "title"], None), (["id", "title"], {"body": "nope"})):
        with pytest.raises(ValueError):
            search.resolve_columns(columns, wanted, given)


def test_payloads_and_contexts(spark):
    pairs = spark.createDataFrame([(1, "PER", f"e{i:02}", f"PER::e{i:02}") for i in range(19)] + [(2, "ORG", "x", "ORG::x")], "article_id bigint, entity_group string, canonical_entity string, canonical_entity_key string")
    a = spark.createDataFrame([(1, " T ", "S ", None), (1, "U", "", ""), (2, None, " ", "b" * 50), (None, "x", "", "")], "article_id bigint, title string, subtitle string, body string")
    got = {(r["article_id"], r["chunk"]): r for r in search.payload_chunks(pairs, search.context_map(a, ["subtitle", "body"], 10), most=5).collect()}
    assert {k: r["n_targets"] for k, r in got.items()} == {(1, 0): 8, (1, 1): 8, (1, 2): 3, (2, 0): 1}
    assert got[1, 1]["coentities"] == "|".join(f"e{i:02} (PER)" for i in range(5)) and got[1, 0]["coentities"].startswith("e08 (PER)") and got[2, 0]["coentities"] == ""
    assert (got[1, 0]["title"], got[1, 0]["context"], got[2, 0]["context"]) == ("T", "S", "b" * 10 + " …")
    assert search.context_map(a, ["body"]).where("article_id = 2").first()["context"] == "b" * 50


def test_type_policies_and_statuses(spark):
    typed = spark.createDataFrame([("PER", "p", "Q1", "L1", "MATCH"), ("PER", "p", "Q2", "L2", "MISMATCH"), ("ORG", "o", "Q1", "L", "UNKNOWN"), ("MISC", "m", "Q1", "L", "UNCHECKED"), ("LOC", "l", "Q1", "L", "MISMATCH")], "entity_group string, canonical_entity_key string, qid string, label string, type_status string")
    status = spark.createDataFrame([("PER", "p", "FOUND"), ("ORG", "o", "FOUND"), ("MISC", "m", "FOUND"), ("LOC", "l", "FOUND"), ("EVENT", "e", "ERROR"), ("PROD", "n", "NO_CANDIDATE")], "entity_group string, canonical_entity_key string, status string")
    got = {r["canonical_entity_key"]: (r["policy"], r["filter_status"], r["one_match_qid"], r["n_candidates"]) for r in linking.filter_summary(typed, status).collect()}
    assert got == {
        "p": ("STRICT", "ONE_TYPE_MATCH", "Q1", 2), "o": ("CONSERVATIVE", "NO_MATCH_WITH_UNKNOWN", None, 1), "m": ("UNCHECKED", "UNCHECKED_GROUP", None, 1),
        "l": ("CONSERVATIVE", "NO_TYPE_MATCH", None, 1), "e": ("DIAGNOSTIC_ONLY", "ERROR", None, 0), "n": ("CONSERVATIVE", "NO_CANDIDATE", None, 0),
    }


def test_quantiles_of_nothing_are_zeros(spark):
    got = linking.metric_quantiles(spark.createDataFrame([], "entity_group string, x double"), ["x"]).collect()
    assert {(r["entity_group"], r["n"], r["p99"], r["max"]) for r in got} == {("ALL", 0, 0.0, 0.0), ("PER", 0, 0.0, 0.0), ("ORG", 0, 0.0, 0.0)}


def test_context_status(spark):
    rows = [(1, "a", "Q1", 1, 0.5), (2, "b", "Q1", 1, 0.0), (2, "b", "Q2", 2, 0.0), (3, "c", "Q1", 1, 0.4), (3, "c", "Q2", 2, 0.4), (4, "d", "Q2", 2, 0.6), (4, "d", "Q1", 1, 0.4), (5, "e", "Q1", 1, 0.5), (5, "e", "Q2", 2, 0.4)]
    s = spark.createDataFrame(rows, "article_id bigint, key string, qid string, candidate_rank int, context_score double")
    got = {r["key"]: (r["status"], r["top_qid"]) for r in linking.context_status(s, ["article_id", "key"]).collect()}
    assert got == {"a": ("SINGLE", "Q1"), "b": ("ZERO", "Q1"), "c": ("TIE", "Q1"), "d": ("UNIQUE_TOP", "Q2"), "e": ("WEAK_TOP", "Q1")}


def spread(n, k):
    if k >= n:
        return list(range(n))
    return [n // 2] if k == 1 else list(dict.fromkeys(round(i * (n - 1) / (k - 1)) for i in range(k)))


@pytest.mark.parametrize("k", [1, 2, 5])
def test_diverse_sample(spark, k):
    rows = [("s", f"e{i % 7}", i) for i in range(97)]
    got = diverse_sample(spark.createDataFrame(rows, "s string, e string, i int"), "s", "e", ["i"], k, 1, Scratch(spark, "t"))
    first = spread(97, min(97, 8 * k))
    want, seen = [], set()
    for i in [*first, *[x for x in range(97) if x not in first]]:
        if i % 7 not in seen and len(want) < k:
            seen.add(i % 7)
            want.append(i)
    assert [r["i"] for r in got.orderBy("sample_rank").collect()] == want


def test_cache_report_and_csv(spark, tmp_path):
    folder = f"{tmp_path}/cache"
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/a.jsonl").write_text('{"k": "x", "v": 1}\nnot json\n{"k": "y", "v": 2}\n{"k": "x", "v": 3}\n')
    got = records.read_cache(spark, folder, "k string, v int", "k")
    assert {tuple(r) for r in got.collect()} == {("x", 3), ("y", 2)}
    records.append_cache(spark.createDataFrame([("z", 9)], "k string, v int"), folder)
    assert records.read_cache(spark, folder, "k string, v int", "k").count() == 3
    assert records.write_report(spark, got.agg(F.count("*").alias("n")).first().asDict(), f"{tmp_path}/r.json") == {"n": 2}  # the files listed when it was read
    records.write_report(spark, {"n": "æ"}, f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"n": "æ"} and not list(tmp_path.glob("*.part"))
    records.write_csv(got, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["k", "v"]
    (tmp_path / "p.json").write_text(json.dumps({"data": "d", "output": "o", "similarity": 0.4}))
    assert records.PipelineConfig.read(f"{tmp_path}/p.json").similarity == 0.4
    (tmp_path / "q.json").write_text(json.dumps({"data": "d", "output": "o", "unknown": 1}))
    with pytest.raises(TypeError):
        records.PipelineConfig.read(f"{tmp_path}/q.json")


def test_claims(spark):
    payload = json.dumps({"claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}, {"mainsnak": {}}]}})
    df = spark.createDataFrame([(payload,), ("{}",), (None,)], "p string")
    assert [r[0] for r in df.select(records.claim_ids(F.col("p"), "P31")).collect()] == [["Q5"], [], []]


def test_article_words_after_3000_characters_count(spark):
    df = spark.createDataFrame([(1, "Nyt", None, "fyld " * 900 + "Skagen")], "article_id int, title string, subtitle string, body string")
    assert set(linking_queries._article_tokens(df).first()["article_tokens"]) == {"nyt", "fyld", "skagen"}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<float>, t array<array<float>>, m array<int>")
    r = df.select(vectors.norm(F.col("v")).alias("n"), vectors.normalised(F.col("v")).alias("u"), vectors.mean_pool(F.col("t"), F.col("m")).alias("p")).first()
    assert r["n"] == 5.0 and r["u"] == pytest.approx([0.6, 0.8]) and r["p"] == [2.0, 3.0]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    m = export.export_package({"t": df}, str(tmp_path), {"t": "k"})
    assert m.first()["n_rows"] == 2
    with pytest.raises(ValueError):
        export.export_package({"t": df.union(df)}, str(tmp_path), {"t": "k"})
    assert export.dangling(df, "k", df.where("k = 1"), "k").first()[0] == 2


def test_streamed_sessions(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", "2016-01-01 00:00:00"), ("a", "2016-01-02 00:00:00"), ("a", "2016-01-09 00:00:00"), ("b", "2016-01-20 00:00:00")]
    (src / "x.json").write_text("\n".join(json.dumps({"k": k, "t": t}) for k, t in rows))
    stream = spark.readStream.schema("k string, t timestamp").json(str(src))
    q = session_counts(stream, "k", "t").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["n"]) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 2)]
