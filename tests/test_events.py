"""Clustering, components and ordered assignment against plain folds."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import compare as X
from newsloom.operators import events as V
from newsloom.operators.graph import ancestors, connected_components
from newsloom.operators.ranking import global_row_number
from newsloom.runtime import Scratch

T0 = dt.datetime(2016, 1, 10)
A, S = "article_id bigint, published_time timestamp_ntz", "article_id bigint, entity string"


def data(seed, n=40):
    rng = random.Random(seed)
    times = {i: T0 + dt.timedelta(hours=rng.choice([0, 12, 24, 72, 100, 150]) + rng.randrange(3)) for i in range(n)}
    sets = {i: {f"e{rng.randrange(14)}" for _ in range(rng.randrange(5))} for i in range(n)}
    return times, sets


def frames(spark, times, sets):
    return spark.createDataFrame(list(times.items()), A), spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], S)


def weights(ids, sets, ratio):
    df = {}
    for i in ids:
        for e in sets[i]:
            df[e] = df.get(e, 0) + 1
    n = len(ids)
    return {e: math.log((n + 1) / (k + 1)) + 1 for e, k in df.items()}, {e for e, k in df.items() if k / n >= ratio}


def brute(times, sets, theta, ratio):
    idf, high = weights(list(times), sets, ratio)
    use = {i: s - high for i, s in sets.items()}
    group = {i: i for i in times}
    for a, b in itertools.combinations(sorted(times, key=lambda i: (times[i], i)), 2):
        inter, union = use[a] & use[b], use[a] | use[b]
        if inter and times[b] - times[a] <= dt.timedelta(hours=72) and round(sum(map(idf.get, sorted(inter))) / sum(map(idf.get, sorted(union))), 9) >= theta:
            old, new = group[a], group[b]
            group = {i: new if g == old else g for i, g in group.items()}
    events = {}
    for i, g in group.items():
        events.setdefault(g, []).append(i)
    ranked = sorted(events.values(), key=lambda m: min((times[i], i) for i in m))
    return {i: k for k, m in enumerate(ranked) for i in m}, idf, high, use


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_and_assignment(spark, seed):
    times, sets = data(seed)
    articles, pairs = frames(spark, times, sets)
    scratch = Scratch(spark, "t")
    c = V.cluster_events(articles, pairs, scratch, 0.3, 72, 0.5)
    want, idf, high, use = brute(times, sets, 0.3, 0.5)
    assert {r["article_id"]: r["event_id"] for r in c["article_events"].collect()} == want
    # later articles
    rng = random.Random(seed)
    late = {100 + i: T0 + dt.timedelta(hours=60 + rng.randrange(160)) for i in range(25)}
    lsets = {i: {f"e{rng.randrange(18)}" for _ in range(rng.randrange(4))} for i in late}
    la, lp = frames(spark, late, lsets)
    got = {r["article_id"]: r["event_id"] for r in V.assign_events(la, lp, c["idf"], c["event_master"], len(times), scratch, 0.3, 72).collect()}
    members = {}
    for i, e in want.items():
        members.setdefault(e, []).append(i)
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    events = [(e, micros(max(times[i] for i in m)), set().union(*(use[i] for i in m))) for e, m in members.items()]
    order = sorted((micros(t), i, lsets[i] - high) for i, t in late.items())
    folded = V.fold(events, order, idf, math.log(len(times) + 1) + 1, 0.3, 72 * 3600 * 1_000_000)
    creators = sorted({c for _, _, c, _ in folded if c is not None}, key=lambda i: (late[i], i))
    new = {c: len(members) + k for k, c in enumerate(creators)}
    assert got == {a: e if e is not None else new[c] for a, e, c, _ in folded}


def naive(events, arrivals, idf, unseen, theta, width):
    """All events are looked at for each arrival: (events by article, pairs within the window, pairs similar enough)."""
    state = {i: [last, set(s)] for i, last, s in events}
    w = lambda s: sum(idf.get(x, unseen) for x in sorted(s))
    out, seen, alike, nxt = {}, 0, 0, max(state, default=-1) + 1
    for t, a, s in arrivals:
        best, chosen = -1.0, None
        for i in sorted(state):
            last, own = state[i]
            if not 0 <= t - last <= width:
                continue
            seen += 1
            sim = round(w(s & own) / w(s | own), 9) if s & own else 0.0
            if sim >= theta:
                alike += 1
                if sim > best:
                    best, chosen = sim, i
        if chosen is None:
            chosen, nxt = nxt, nxt + 1
            state[chosen] = [t, set()]
        state[chosen] = [t, state[chosen][1] | s]
        out[a] = chosen
    return out, seen, alike


@pytest.mark.parametrize("seed", [3, 4])
def test_assignment_of_one_component_with_gaps(spark, seed):
    """All share entities, so they are one component; its times leave gaps, so it is folded in parts that equal the whole."""
    rng = random.Random(seed)
    hours = lambda: rng.choice([0, 300, 420, 1000]) + rng.randrange(60)
    pick = lambda k: {f"e{rng.randrange(6)}" for _ in range(k)}
    train = {i: (T0 + dt.timedelta(hours=hours()), pick(2)) for i in range(30)}
    late = {100 + i: (T0 + dt.timedelta(hours=50 + hours()), pick(rng.randrange(4))) for i in range(40)}
    scratch = Scratch(spark, "t")
    c = V.cluster_events(*frames(spark, {i: t for i, (t, _) in train.items()}, {i: s for i, (_, s) in train.items()}), scratch, 0.9, 72, 1.0)
    la, lp = frames(spark, {i: t for i, (t, _) in late.items()}, {i: s for i, (_, s) in late.items()})
    got = scratch.keep(V.assign_events(la, lp, c["idf"], c["event_master"], len(train), scratch, 0.4, 72))
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    rows = c["event_master"].collect()
    idf = {r["entity"]: r["idf"] for r in c["idf"].collect()}
    high = {r["entity"] for r in c["idf"].where("is_high_df").collect()}
    order = sorted((micros(t), i, s - high) for i, (t, s) in late.items())
    want, seen, alike = naive([(r["event_id"], micros(r["event_last_added_time"]), set(r["event_entities"])) for r in rows], order, idf, math.log(len(train) + 1) + 1, 0.4, 72 * 3600 * 10**6)
    assert {r["article_id"]: r["event_id"] for r in got.collect()} == want
    assert V.pairs_looked_at(c["event_master"], got, scratch, 72).first()[0] == seen and got.agg(F.sum("alike")).first()[0] == alike
    with_entities = got.join(lp.select("article_id").distinct(), "article_id", "left_semi")
    assert with_entities.groupBy("component").count().count() > 2


def test_pair_counts_and_unequal_clusterings(spark):
    rng = random.Random(2)
    schema = "article_id bigint, event_id bigint"
    l, r = ([(i, rng.randrange(12)) for i in range(60)] for _ in range(2))
    left, right = spark.createDataFrame(l, schema), spark.createDataFrame(r, schema)
    pairs = lambda rows: {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x == y}
    p, q = pairs(l), pairs(r)
    assert X.pair_counts(left, right).first().asDict() == {"common_pairs": len(p & q), "removed_pairs": len(p - q), "added_pairs": len(q - p)}
    assert {(x["article_a"], x["article_b"], x["change"]) for x in X.pair_diff(left, right).collect()} == {(*x, "ADDED") for x in q - p} | {(*x, "REMOVED") for x in p - q}
    X.require_same_articles(left, right)
    for a, b in ((left, right.where("article_id < 59")), (left.union(left.limit(1)), right)):
        with pytest.raises(ValueError):
            X.require_same_articles(a, b)


def test_pairs_in_window(spark):
    times, _ = data(5, 60)
    articles, _ = frames(spark, times, {0: {"x"}})
    n = sum(abs(times[a] - times[b]) <= dt.timedelta(hours=72) for a, b in itertools.combinations(times, 2))
    assert V.pairs_in_window(articles).first()[0] == n
    assert V.pairs_in_window(articles.limit(0)).first()[0] == 0


def test_window_edge(spark):
    at = {1: T0, 2: T0 + dt.timedelta(hours=72), 3: T0 + dt.timedelta(hours=72, microseconds=1)}
    articles, pairs = frames(spark, at, {i: {"x"} for i in at})
    sims = V.similarity_pairs(pairs.withColumn("idf", F.lit(1.0)), articles)
    assert sorted((r["a"], r["b"]) for r in sims.collect()) == [(1, 2), (2, 3)]


def test_no_entities_and_empty(spark):
    articles, _ = frames(spark, {1: T0, 2: T0}, {})
    c = V.cluster_events(articles, spark.createDataFrame([], S), Scratch(spark, "t"))
    assert sorted(tuple(r) for r in c["article_events"].select("article_id", "event_id").collect()) == [(1, 0), (2, 1)]
    assert V.cluster_events(articles.limit(0), spark.createDataFrame([], S), Scratch(spark, "t"))["event_master"].isEmpty()
    with pytest.raises(ValueError):
        V.cluster_events(articles, spark.createDataFrame([], S), Scratch(spark, "t"), theta=0)


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame([(a, b) for a, b in itertools.pairwise(ids)] + [(500, 501), (501, 500), (7, 7)], "a bigint, b bigint")
    got = {r["v"]: r["component"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(ids, 0), 500: 500, 501: 500}


def test_ancestors(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b")], "child string, parent string")
    got = {tuple(r) for r in ancestors(e, spark.createDataFrame([("a",), ("x",)], "node string"), Scratch(spark, "t"), 2).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("x", "x", 0), ("x", "b", 1), ("x", "c", 2)}


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = global_row_number(df, ["k"], "n", Scratch(spark, "t"), start=5)
    assert got.where("n <> k + 5").isEmpty() and got.count() == 1000
    assert global_row_number(df.limit(0), ["k"], "n", Scratch(spark, "t")).isEmpty()


def test_comparing_a_clustering_with_itself(spark):
    e = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "article_id bigint, event_id bigint")
    assert X.pair_diff(e, e).isEmpty() and X.merges_and_splits(e, e).isEmpty()
    other = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "article_id bigint, event_id bigint")
    assert {(r["article_a"], r["article_b"], r["change"]) for r in X.pair_diff(e, other).collect()} == {(2, 3, "ADDED"), (1, 2, "REMOVED")}
    assert {(r["kind"], r["event_id"]) for r in X.merges_and_splits(e, other).collect()} == {("MERGE", 1), ("SPLIT", 0)}
