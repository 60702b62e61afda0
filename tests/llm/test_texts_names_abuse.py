"""Plain forms, name variants and the abuse model."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm.abuse import Model, clean, sentences
from newsloom.llm.abuse_queries import fit, scored
from newsloom.llm.entitynames import Similarity, edits, parse, role_keys, spelling_keys
from newsloom.llm.linkname_queries import p2_found
from newsloom.llm.linknames import bands_for, candidates, keyed, link_names, q_grams, star_clusters
from newsloom.llm.lookalikes import LOOKS_LIKE, ODD_TEXT, Trie, bare, by_table, is_odd, options, plain_text, skeleton
from newsloom.llm.plainform import plain_forms
from newsloom.runtime import Scratch

DISGUISED = {
    "Kød­priser": "Kødpriser", "Ｎｏｒｄ　by": "Nord by", "Nordby​": "Nordby", "Né": "Né", "Ηοldіnɡ": "Holding", "Logiﬆics": "Logistics", "Åse": "Åse", "GmbΗ": "GmbH",
    "ǉnd": "ljnd", "Grånӕs": "Grånæs", "a b": "a b", "👩‍🚒 x‍": "👩‍🚒 x",
}
PLAIN = ["3½ m² № 7", "«Nå» – “ja” ‘x’ …", "👩‍🚒 ❤️ 1️⃣", "Жулинск", "ΘΥΜΏΔΙΑ", "Łódź é ü", "  to  rum ", "", " ", "CO₂"]


@pytest.mark.parametrize(("text", "plain"), DISGUISED.items())
def test_disguised(text, plain):
    assert plain_text(text, {}) == plain


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert plain_text(text, {}) == text


def test_trie_prefers_words_and_counts():
    t = Trie()
    for w, n in (("holding", 3), ("nolding", 9), ("жулинск", 1), ("ab", 2)):
        t.add(w, n)
    assert t.read("ηοldіnɡ") == "nolding" and t.read("Ho​ldіng") == "holding" and t.read("ΑΒ") == "ab"
    assert t.read("Жулинск") == "жулинск" and t.read("xyz") is None and t.read("holdingss", 1.0) is None and t.read("holdings", 1.0) == "holding" and t.read("halding", 1.0) == "holding"


WORDS = {"berlin": 5, "madrid": 4, "london": 3, "londo": 9, "lindon": 1, "rom": 2, "paris": 7, "holding": 3}


def priced(token: str, budget: float) -> str | None:
    """Plain edit distance to every word, look-alikes free."""
    clean = [x for x in bare(token).lower()]

    def cost(word: str) -> int:
        row = list(range(len(word) + 1))
        for i, ch in enumerate(clean, 1):
            before, row = row, [i]
            for j, y in enumerate(word, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (y not in options(ch))))
        return row[-1]

    best = min((cost(w), -n, w) for w, n in WORDS.items())
    return best[2] if best[0] <= budget else None


TOKENS = ["bеrli", "bеrlim", "mаdrit", "lоndоm", "lоn​don", "раris", "рarris", "rоm", "xyzzу", "hоlding", "оldinɡ"]


@pytest.mark.parametrize("budget", [0.0, 1.0, 2.0])
def test_a_trie_weighs_letters(budget):
    t = Trie()
    for w, n in WORDS.items():
        t.add(w, n)
    assert {x: t.read(x, budget) for x in TOKENS} == {x: priced(x, budget) for x in TOKENS}


@pytest.mark.parametrize("shard_words", [1, 1000])
def test_a_budget_is_met_whatever_the_shards(spark, shard_words):
    plain = [w for w, n in WORDS.items() for _ in range(n)]
    df = spark.createDataFrame([(" ".join([w, str(i)]),) for i, w in enumerate(plain)] + [(x,) for x in TOKENS], "text string")
    got = {r["text"]: r["plain"] for r in plain_forms(df, Scratch(spark, "t"), 1.0, shard_words).collect()}
    assert got == {x: plain_text(x, {x: priced(x, 1.0)}) for x in TOKENS}


def test_skeletons_meet():
    for ch, looks in LOOKS_LIKE.items():
        assert all(skeleton(ch) == skeleton(x) for x in looks)
    assert by_table("Кравоgорск")[:5] == "Краво" and not is_odd("Søren") and is_odd("С")


def test_plain_forms_in_context(spark):
    rows = ["Transport AB", "Transport ΑΒ", "Кравогорск", "Кравогорск ОКО", "Jens ОКО", "Oko Jens", None, "", "x​" * 5000]
    got = {r["text"]: r["plain"] for r in plain_forms(spark.createDataFrame([(r, 1) for r in rows], "text string, plain int").select("text"), Scratch(spark, "t")).collect()}
    assert got["Transport ΑΒ"] == "Transport AB" and got["Кравогорск"] == "Кравогорск" and got["Кравогорск ОКО"] == "Кравогорск ОКО"
    assert got["Jens ОКО"] == "Jens OKO" and "Transport AB" not in got and got["x​" * 5000] == "x" * 5000
    assert plain_forms(spark.createDataFrame([], "text string"), Scratch(spark, "t")).isEmpty()


def test_parsing():
    assert parse("dr. anne-marie k. møller", "PER") == (("annemarie", "møller"), "", ("k",))
    assert parse("møller, a.", "PER")[0] == ("møller", "a")
    assert parse("nord bibl.for. & en. a/s", "ORG") == (("nord", "biblfor.", "en."), "as", ())
    assert parse("moeller", "PER")[0] == parse("møller", "PER")[0]
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 1) == 2


def test_similarity():
    s = Similarity({"anne", "jens", "energi", "foods", "biblioteksforening"}, {"lis": {"elisabeth"}})
    same = [("anne vådahylund", "vådahylund, anne"), ("a. vådahylund", "anne vådahylund"), ("lis vådahylund", "elisabeth vådahylund"), ("anne vådahyund", "anne vådahylund"), ("vådahylund", "anne vådahylund"), ("anne vådahylunds", "hr. anne vådahylund")]
    other = [("jens vådahylund", "anne vådahylund"), ("anne vådahylund", "anne pøtyrgaard"), ("anne", "jens"), ("anne k. vådahylund", "anne b. vådahylund")]
    assert all(s(a, b, "PER")[0] >= 0.7 for a, b in same) and all(s(a, b, "PER")[0] < 0.7 for a, b in other)
    assert s("virørkæji bibl.for. ab", "virørkæji biblioteksforening", "ORG")[0] >= 0.7
    assert s("virørkæji energi", "virørkæji foods", "ORG")[0] < 0.7 and s("virørkæji energi ab", "virørkæji energi aps", "ORG")[0] < 0.7
    assert s("", "x", "PER") == (0.0, False)


def test_collision_curve():
    b = bands_for(0.35, 0.95, 3)
    assert 1 - (1 - 0.35**3) ** b >= 0.95 > 1 - (1 - 0.35**3) ** (b - 1)


def test_every_look_alike_passes_the_prefilter(spark):
    assert all(re.search(ODD_TEXT, "ab" + x) for x in LOOKS_LIKE) and not re.search(ODD_TEXT, "Łódź Ærø Ögård né – “x”")
    df = spark.createDataFrame([("Nordby Holding",), ("Nordby Holdıng",), ("Kƽ",), ("Næstved",)], "text string")
    got = {r["text"]: r["plain"] for r in plain_forms(df, Scratch(spark, "t")).collect()}
    assert got == {"Nordby Holdıng": "Nordby Holding", "Kƽ": "Ks"}
    assert clean("du er en ıdiot") == "du er en idiot"


@pytest.mark.parametrize("n", [1500, 8000])
def test_band_recall_of_typing_errors_holds_as_names_grow(spark, n):
    rng = random.Random(5)

    def swapped(x):
        i = rng.randrange(1, len(x) - 2)
        return x[:i] + x[i + 1] + x[i] + x[i + 2 :]

    surnames = {"".join(rng.choice("bdfgklmnrstv") + rng.choice("aeiouy") for _ in range(5)) for _ in range(n)}
    pairs = {(s, swapped(s)) for s in sorted(surnames)[::5]}
    names = sorted(surnames | {b for _, b in pairs})
    df = spark.createDataFrame([("PER", i, x, q_grams((x,)), [x]) for i, x in enumerate(names)], "grp string, id bigint, name string, grams array<string>, tokens array<string>").withColumn("c", F.xxhash64("grp", "grams"))
    got = {(names[r["a"]], names[r["b"]]) for r in candidates(df, {"PER": len(names)}, 3, bands_for(0.35, 0.95, 3), Scratch(spark, "t"), {"PER": set()}, {}).collect()}
    pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    assert len(pairs & got) / len(pairs) > 0.96


def test_stars_equal_the_greedy_order(spark):
    edges = {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5), (6, 7)}
    rank = {0: 1, 1: 5, 2: 4, 3: 3, 4: 6, 5: 2, 6: 9, 7: 8, 8: 0}
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in rank}
    centre = []
    for v in sorted(rank, key=rank.get, reverse=True):
        if not near[v] & set(centre):
            centre.append(v)
    want = {v: v if v in centre else max(near[v] & set(centre), key=rank.get) for v in rank}
    both = [(a, b, 0.9) for x, y in edges for a, b in ((x, y), (y, x))]
    got = star_clusters(spark.createDataFrame(list(rank.items()), "v int, rank int"), spark.createDataFrame(both, "x int, y int, sim double"), Scratch(spark, "t"))
    assert {r["v"]: r["centre"] for r in got.collect()} == want


def test_nothing_is_left_undecided_in_silence(spark):
    chain = spark.createDataFrame([(i, -i) for i in range(12)], "v int, rank int")
    both = spark.createDataFrame([(a, b, 0.9) for i in range(11) for a, b in ((i, i + 1), (i + 1, i))], "x int, y int, sim double")
    with pytest.raises(RuntimeError):
        star_clusters(chain, both, Scratch(spark, "t"), max_rounds=3)
    assert star_clusters(chain, both, Scratch(spark, "t")).count() == 12
    names = spark.createDataFrame([("PER", "wanda fælerrudø")], "grp string, name string")
    many = spark.range(100_001).selectExpr("cast(id as string) given_name", "'x' nickname")
    with pytest.raises(ValueError):
        link_names(names, many, Scratch(spark, "t"))


def names_of_one_surname(n: int) -> tuple[list[str], list[tuple[str, str]]]:
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("bdfgklmnrstv") + rng.choice("aeiouy") for _ in range(k))
    given = sorted({word(5) for _ in range(n)})
    names, pairs = [f"{g} hansenrup" for g in given], []
    for i, g in enumerate(given[::500]):
        other = [f"hansenrup, {g}", f"{g[:4]}{g[5]}{g[4]}{g[6:]} hansenrup", f"{g} hansenru", f"hr. {g} hansenrups"][i % 4]
        pairs.append((f"{g} hansenrup", other))
    return names + [b for _, b in pairs], pairs


def test_a_surname_of_thousands_forms_no_pairs_of_all(spark):
    names, pairs = names_of_one_surname(20_000)
    df = spark.createDataFrame([("PER", i, x, q_grams(parse(x, "PER")[0]), list(parse(x, "PER")[0])) for i, x in enumerate(names)], "grp string, id bigint, name string, grams array<string>, tokens array<string>").withColumn("c", F.xxhash64("grp", "grams"))
    met = candidates(df, {"PER": len(names)}, 3, bands_for(0.35, 0.95, 3), Scratch(spark, "t"), {"PER": set()}, {})
    got = {(names[r["a"]], names[r["b"]]) for r in met.collect()}
    assert all((a, b) in got or (b, a) in got for a, b in pairs) and met.count() == len(got)
    assert len(got) < 20 * len(names)


@pytest.mark.parametrize(("bucket", "entities"), [(128, 150), (1, 150), (128, 1300)])
def test_links_of_planted_variants(spark, bucket, entities):
    """Few names or many (on either side of every least number), bucket pairs or (bucket 1) pairs by tokens: planted variants are linked, others aren't."""
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("bdfgklmnrstv") + rng.choice("aeiouyæøå") for _ in range(k))
    given = sorted({word(3) for _ in range(14)})
    rows, true = [], {}
    for i in range(entities):
        g, s = rng.choice(given), word(5)
        true[i] = {f"{g} {s}", f"{s}, {g}", f"{g[0]}. {s}", f"{g} {s[:3]}{s[4:]}", f"{g} k. {s}", f"hr. {g} {s}s"}
        rows += [("PER", f) for f in true[i]]
    df = spark.createDataFrame(rows, "grp string, name string")
    got = {r["name"]: r["entity"] for r in link_names(df, spark.createDataFrame([], "given_name string, nickname string"), Scratch(spark, "t"), bucket=bucket).collect()}
    pairs = [(a, b) for forms in true.values() for a, b in itertools.combinations(sorted(forms), 2)]
    owner = {}
    for i, forms in true.items():
        for f in forms:
            owner.setdefault(got[f], set()).add(i)
    recall = sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    print(f"bucket {bucket}, {len(got)} names: recall {recall:.3f}, stars of several {sum(len(x) > 1 for x in owner.values())}")
    assert recall >= 0.96 and sum(len(x) > 1 for x in owner.values()) <= 0.01 * len(owner)


def test_no_table_of_names_is_broadcast(spark):
    executions = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = executions().size()
    assert p2_found(spark, "/root/testdata/sf0.001").count() > 0
    after = executions()
    plans = [after.apply(i).physicalPlanDescription() for i in range(before, after.size())]
    assert len(plans) > 10
    assert not [x for x in plans if "Broadcast" in x]


def test_bands_are_not_kept(spark, monkeypatch):
    """A name has 69 bands; what is written is in proportion to the names."""
    names, pairs = names_of_one_surname(3000)
    counts, keep = [], Scratch.keep

    def counted(self, *a):
        out = keep(self, *a)
        counts.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([("PER", x) for x in names], "grp string, name string")
    got = {r["name"]: r["entity"] for r in link_names(df, spark.createDataFrame([], "given_name string, nickname string"), scratch).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= len(pairs) - 1
    assert max(counts) < 20 * len(names)


@pytest.mark.parametrize("group", ["PER", "ORG"])
def test_tokens_held_alike_share_a_key(group):
    common, nicknames = {"magdalene", "forsikring", "anna"}, {"lene": {"magdalene"}}
    tokens = ["magdalene", "magdalne", "magda", "lene", "m", "m.", "anna", "ana", "fors.", "frs", "forsikring", "forsikrings", "hansen", "hanesn", "hasn"]
    measure = Similarity(common, nicknames)
    for a in tokens:
        for b in tokens:
            if a < b and measure.token(a, b, group) > 0:
                (x, y), (p, q) = [spelling_keys(t, group, nicknames) for t in (a, b)], [role_keys(t, group, frozenset(common)) for t in (a, b)]
                met = {(k, 3 - r) for k, r in p} & q
                assert x & y or met, (a, b)


def test_keys_come_a_few_tokens_at_a_time(spark):
    tokens = spark.range(3000).selectExpr("'PER' as grp", "concat('navn', id) as token", "id as t").coalesce(1)
    assert keyed(tokens, lambda x, g: [(x, 0), (g, 1)]).groupBy("role").agg(F.count_distinct("key").alias("n")).orderBy("role").collect() == [(0, 3000), (1, 1)]


def test_linking(spark):
    names = {"PER": ["wanda fælerrudø", "fælerrudø, wanda", "w. fælerrudø", "wanda fælerudø", "wanda faelerrudoe", "jens fælerrudø", "tove pemilbøjø", "", None], "ORG": ["gæsybo energi", "energi, gæsybo ab", "gæsybo en.", "gæsybo foods"]}
    df = spark.createDataFrame([(g, n, 0) for g, ns in names.items() for n in ns], "grp string, name string, entity int")
    nick = spark.createDataFrame([("Elisabeth", "Lis"), (None, "x")], "given_name string, nickname string")
    got = {(r["grp"], r["name"]): r["entity"] for r in link_names(df, nick, Scratch(spark, "t"), recall=0.999).collect()}
    assert len(got) == 11
    assert len({got["PER", n] for n in names["PER"][:5]}) == 1
    assert len({got["PER", "wanda fælerrudø"], got["PER", "jens fælerrudø"], got["PER", "tove pemilbøjø"]}) == 3
    assert got["ORG", "gæsybo energi"] == got["ORG", "energi, gæsybo ab"] != got["ORG", "gæsybo foods"]
    assert link_names(df.limit(0), nick, Scratch(spark, "t")).isEmpty()


BAD, GOOD = ["du er en klaphat", "sikke en torsk du er", "skrid din nar"], ["vejret er fint", "byen får en bro", "tak for kaffen", "manden kaldte ham en «klaphat»"]


def corpus(n=600):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(n):
        parts = [GOOD[i] for i in rng.integers(0, 4, rng.integers(1, 6))]
        bad = rng.random() < 0.3
        if bad:
            parts.insert(int(rng.integers(0, len(parts) + 1)), BAD[int(rng.integers(0, 3))])
        texts.append(". ".join(parts) + ".")
        labels.append(float(bad if rng.random() > 0.02 else not bad))
    return texts, np.array(labels)


def test_model_on_held_out_documents():
    texts, labels = corpus()
    m = Model.fit(texts[:400], labels[:400])
    s, at, _ = m.score(texts[400:])
    truth = np.array([any(b in t for b in BAD) for t in texts[400:]])
    assert ((s >= m.threshold) == truth).mean() > 0.97
    assert all(any(b in sentences(t)[k] for b in BAD) for t, k, bad in zip(texts[400:], at, truth, strict=True) if bad)
    hidden = ["Vejret er fint. Du er en k l a p h a t", "du er en kl​аphat", "du er en klaphatt", "du er en kl4phat"]
    assert (m.score(hidden)[0] >= m.threshold).all() and m.score(["", " "])[0].max() < m.threshold


def test_clean_undoes_disguises():
    assert clean("K.L.A.P.H.A.T") == "klaphat" and clean("a­b Ｃ") == "ab c" and clean("14.30") == "14.30"


def test_scoring_documents(spark):
    texts, labels = corpus(300)
    docs = spark.createDataFrame([*[(i, t, "s") for i, t in enumerate(texts)], (900, None, "s"), (901, "", None), (902, "vejret er fint. " * 20_000 + BAD[0], "s")], "doc_id bigint, text string, score string").drop("score")
    rows = spark.createDataFrame([*[(i, int(y), "a") for i, y in enumerate(labels)], (0, int(labels[0]), "a"), (1, 1 - int(labels[1]), "b"), (5000, 1, "a"), (None, 1, "a"), (3, None, "a")], "doc_id bigint, abusive int, rater string")
    model = fit(docs, rows)
    got = {r["doc_id"]: r for r in scored(docs, model).collect()}
    assert len(got) == 303 and got[900]["score"] == 0 and got[900]["sentence"] is None and got[902]["sentence"] == BAD[0]
    few = fit(docs, rows, 40, 60, chars=4000)  # documents that no longer fit are passed over, not cut
    assert 0 < len(few.words) < len(model.words) + 1
    empty = fit(docs, rows.limit(0))
    assert scored(docs, empty).where(f"score >= {empty.threshold}").isEmpty()
    assert scored(docs.limit(0), model).isEmpty()
