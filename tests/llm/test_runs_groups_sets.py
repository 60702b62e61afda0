"""Runs, groups and set joins against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm.groups import consolidate
from newsloom.llm.runs import collapse_runs
from newsloom.llm.setjoin import similar_pairs
from newsloom.runtime import Scratch

EVENTS = "seq string, entity bigint, ts bigint, key bigint, item bigint, ts_end int"  # one column that isn't read
M = 60 * 1_000_000


def brute_runs(rows, gap):
    out = set()
    for (seq, entity), own in itertools.groupby(sorted({r[:5] for r in rows}), key=lambda r: r[:2]):
        runs = []
        for _, _, t, k, item in own:
            if runs and runs[-1]["item"] == item and t - runs[-1]["t1"] <= gap:
                runs[-1].update(t1=t, k1=k, n=runs[-1]["n"] + 1)
            else:
                runs.append({"item": item, "t0": t, "t1": t, "k0": k, "k1": k, "n": 1})
        out |= {(seq, entity, r["item"], r["k0"], r["k1"], r["n"], (r["t1"] - r["t0"]) // 1_000_000) for r in runs if r["n"] >= 2}
    return out


@pytest.mark.parametrize("chunks", [1, 7, 90])
def test_runs(spark, chunks):
    rng = random.Random(chunks)
    rows = [(s, e, rng.randrange(400) * 10 * M, k, rng.randrange(3), 0) for s in ("a", "b") for e, n in ((1, 400), (2, 30), (3, 1)) for k in range(n)]
    rows += rng.sample(rows, 50)  # repeated rows
    got = collapse_runs(spark.createDataFrame(rows, EVENTS).repartition(6), Scratch(spark, "t"), 1800, 2, chunks)
    assert {tuple(r) for r in got.collect()} == brute_runs(rows, 30 * M) and got.count() == got.distinct().count()


def test_run_edges(spark):
    rows = [("a", 1, 0, 1, 7, 0), ("a", 1, 30 * M, 2, 7, 0), ("a", 1, 60 * M + 1, 3, 7, 0), ("a", 2, 5, 2, 1, 0), ("a", 2, 5, 1, 1, 0)]
    got = collapse_runs(spark.createDataFrame(rows, EVENTS), Scratch(spark, "t"))
    assert {tuple(r) for r in got.collect()} == {("a", 1, 7, 1, 2, 2, 1800), ("a", 2, 1, 1, 2, 2, 0)}
    assert collapse_runs(spark.createDataFrame([], EVENTS), Scratch(spark, "t")).isEmpty()


def test_one_run_over_all_slices(spark):
    rows = [("a", 1, i * M, i, 7, 0) for i in range(500)]
    got = [tuple(r) for r in collapse_runs(spark.createDataFrame(rows, EVENTS), Scratch(spark, "t"), 1800, 2, 25).collect()]
    assert got == [("a", 1, 7, 0, 499, 500, 499 * 60)]


@pytest.mark.parametrize("spread", [M, 0])
def test_a_hot_entity_with_an_outlying_time_is_cut_evenly(spark, spread):
    """One entity has 90 % of the events; one of its times lies far away, or all but that one are equal."""
    rows = [("a", 1, 10**16 if i == 0 else i * spread, i, i // 3, 0) for i in range(9000)] + [("a", 2 + i % 50, i * M, i, 1, 0) for i in range(1000)]
    events = spark.createDataFrame(rows, EVENTS)
    assert {tuple(r) for r in collapse_runs(events, Scratch(spark, "t"), 1800, 2, 10).collect()} == brute_runs(rows, 30 * M)
    per = events.repartitionByRange(10, "seq", "entity", "ts", "key").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per < 2000


def brute_groups(rows):
    group = {a: a for a, _ in rows if a is not None}
    by_key = {}
    for a, k in rows:
        if a is not None and k is not None:
            by_key.setdefault(k, set()).add(a)
    moved = True
    while moved:
        moved = False
        for members in by_key.values():
            low = min(group[a] for a in members)
            for a in members:
                if group[a] != low:
                    group[a], moved = low, True
    return group


@pytest.mark.parametrize("peel", [0, 1, 6])
def test_groups(spark, peel):
    rng = random.Random(peel)
    ids = rng.sample(range(1000), 300)
    chain = [(a, f"c{i}") for i, pair in enumerate(itertools.pairwise(ids[:120])) for a in pair]  # a long chain
    hub = [(a, "hub") for a in ids[110:180]]  # one key held by many, tied to the chain
    rows = chain + hub + [(rng.choice(ids), f"r{rng.randrange(150)}") for _ in range(150)] + [(a, None) for a in ids[-20:]] + [(None, "hub"), (2000, "alone")]
    rows += rng.sample(rows, 60)
    df = spark.createDataFrame([(a, k, 1) for a, k in rows], "rec int, k string, label int")
    got = consolidate(df, "rec", "k", Scratch(spark, "t"), peel)
    assert {r["rec"]: r["group_id"] for r in got.collect()} == brute_groups(rows) and got.count() == len(brute_groups(rows))


def test_groups_without_links(spark):
    assert consolidate(spark.createDataFrame([], "rec int, k string"), "rec", "k", Scratch(spark, "t")).isEmpty()
    got = consolidate(spark.createDataFrame([(3, None), (1, "x"), (3, None)], "rec int, k string"), "rec", "k", Scratch(spark, "t"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (3, 3)]


def sets(rng, n, shift=0):
    rows = []
    for i in range(n):
        tokens = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(8))] + rng.choice([[], [None], ["zz"]])
        rows.append((i + shift, rng.randrange(300), rng.choice([None, tokens, tokens, tokens])))
    rows += [(500 + shift + i, 100 + i, ["p", "q", "r", "s"]) for i in range(25)]  # equal sets
    return rows


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_similar_pairs(spark, threshold):
    rows = sets(random.Random(int(threshold * 100)), 120)
    clean = {i: (t, {x for x in s or [] if x is not None}) for i, t, s in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(clean), 2) if abs(clean[a][0] - clean[b][0]) <= 50 and min(len(clean[a][1]), len(clean[b][1])) >= 2 and jaccard(clean[a][1], clean[b][1]) >= threshold - 1e-9}
    got = similar_pairs(spark.createDataFrame(rows, "id bigint, ts bigint, tokens array<string>"), Scratch(spark, "t"), threshold, 50, 2)
    pairs = [(r["id_a"], r["id_b"]) for r in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_pairs_without_a_span(spark, threshold):
    rows = sets(random.Random(7), 120)
    clean = {i: {x for x in s or [] if x is not None} for i, _, s in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(clean), 2) if clean[a] and clean[b] and jaccard(clean[a], clean[b]) >= threshold - 1e-9}
    got = [(r["id_a"], r["id_b"]) for r in similar_pairs(spark.createDataFrame(rows, "id bigint, ts bigint, tokens array<string>"), Scratch(spark, "t"), threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def test_similar_pairs_of_two_tables(spark):
    rng = random.Random(9)
    left, right = sets(rng, 60), sets(rng, 60, 1000)
    schema = "id bigint, ts bigint, tokens array<string>"
    prep = lambda rows: {i: (t, {x for x in s or [] if x is not None}) for i, t, s in rows}
    a, b = prep(left), prep(right)
    for span in (None, 40):
        want = {(x, y) for x in a for y in b if a[x][1] and b[y][1] and jaccard(a[x][1], b[y][1]) >= 0.6 and (span is None or abs(a[x][0] - b[y][0]) <= span)}
        got = similar_pairs(spark.createDataFrame(left, schema), Scratch(spark, "t"), 0.6, span, 1, spark.createDataFrame(right, schema))
        pairs = [(r["id_a"], r["id_b"]) for r in got.collect()]
        assert set(pairs) == want and len(pairs) == len(want)


def test_similar_pairs_of_nothing(spark):
    schema = "id bigint, ts bigint, tokens array<string>"
    assert similar_pairs(spark.createDataFrame([], schema), Scratch(spark, "t"), 0.5, 10, 1).isEmpty()
    assert similar_pairs(spark.createDataFrame([(1, None, ["a"]), (None, 1, ["a"]), (2, 1, None)], schema), Scratch(spark, "t"), 0.5, 10, 1).isEmpty()
