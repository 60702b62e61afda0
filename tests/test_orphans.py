"""The orphan cascade against hand-made cases."""

import datetime as dt
from pathlib import Path

import pytest

from newsloom.operators.orphans import Reference, cascade
from newsloom.plans.orphan_queries import p6_report
from newsloom.runtime import Scratch
from newsloom.sources import load

T0 = dt.datetime(2016, 1, 20)
REF = "ref_key bigint, parent_key bigint, ref_time timestamp_ntz, article_id int"  # one column more than is read
PARENT = "parent_key bigint, born timestamp_ntz"


def run(spark, refs, parents, limit=10):
    e = Reference("t.x", "t", "p", spark.createDataFrame(refs, REF))
    return cascade([e], {"p": spark.createDataFrame(parents, PARENT)}, Scratch(spark, "t"), limit)


@pytest.mark.parametrize("limit", [0, 10])
def test_kinds_days_and_repeats(spark, limit):
    late = T0 + dt.timedelta(hours=1)
    refs = [(1, 5, T0, 0), (1, 5, T0, 0), (2, 6, T0, 0), (3, 7, None, 0), (4, None, T0, 0), (5, 0, None, 0), (6, -3, T0, 0), (7, 8, T0, 0), (8, 9, T0, 0)]
    parents = [(6, late), (7, late), (8, None), (9, T0)]
    rows = {tuple(r) for r in run(spark, refs, parents, limit).select("ref_key", "parent_key", "orphan_kind", "ref_day").collect()}
    assert rows == {(1, 5, "absent", "2016-01-20"), (2, 6, "later", "2016-01-20"), (5, 0, "absent", "unknown"), (6, -3, "absent", "2016-01-20")}


def test_empty_tables(spark):
    assert run(spark, [], [(1, T0)]).isEmpty()
    assert run(spark, [(1, 5, T0, 0)], []).count() == 1


def test_inherited_orphans_end_in_a_cycle(spark):
    ref = lambda rows: spark.createDataFrame([(*r, T0, 0) for r in rows], REF)
    edges = [
        Reference("doc.article", "doc", "art", ref([(10, 1), (11, 2)])),
        Reference("label.doc", "label", "doc", ref([(100, 10), (101, 11)])),
        Reference("note.label", "note", "label", ref([(7, 100), (8, 101)])),
        Reference("doc.note", "doc", "note", ref([(11, 7)])),
    ]
    keys = lambda ks: spark.createDataFrame([(k, None) for k in ks], PARENT)
    out = cascade(edges, {"art": keys([2]), "doc": keys([10, 11]), "label": keys([100, 101]), "note": keys([7, 8])}, Scratch(spark, "t"))
    got = {(r["child"], r["ref_key"]): r["depth"] for r in out.collect()}
    assert got.pop(("doc", 10)) == 0
    assert got == {("label", 100): 1, ("note", 7): 2, ("doc", 11): 3, ("label", 101): 4, ("note", 8): 5}


def test_one_hot_parent(spark):
    refs = [(i, 5, T0, 0) for i in range(3000)]
    assert run(spark, refs, [(6, T0)]).count() == 3000


def test_a_long_chain_is_walked_to_its_end(spark):
    n = 66
    ref = lambda rows: spark.createDataFrame([(*r, T0, 0) for r in rows], REF).coalesce(1)
    edges = [Reference("doc.article", "doc", "art", ref([(1, 9)])), Reference("doc.doc", "doc", "doc", ref([(i + 1, i) for i in range(1, n)]))]
    keys = lambda ks: spark.createDataFrame([(k, None) for k in ks], PARENT).coalesce(1)
    out = cascade(edges, {"art": keys([]), "doc": keys(range(1, n + 1))}, Scratch(spark, "t"))
    assert {(r["ref_key"], r["depth"]) for r in out.collect()} == {(i + 1, i) for i in range(n)}


def test_report_holds_the_orphans_of_article_events(spark, tmp_path):
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if p.stem != "article_events":
            (tmp_path / p.name).symlink_to(p)
    late, known = T0 - dt.timedelta(days=9999), load(spark, str(tmp_path), "articles").where("published_time is not null and article_id > 0").first()["article_id"]
    rows = [(-77, 1, T0), (-77, 1, T0), (-77, 2, T0), (-78, None, None), (None, 3, T0), (known, 4, late), (known, 4, dt.datetime(2099, 1, 1))]
    spark.createDataFrame(rows, "article_id bigint, event_id bigint, published_time timestamp_ntz").write.parquet(f"{tmp_path}/article_events.parquet")
    got = {(r["orphan_kind"], r["ref_day"]): (r["n_refs"], r["n_records"]) for r in p6_report(spark, str(tmp_path)).where("ref_field = 'article_events.article_id'").collect()}
    assert got == {("absent", "2016-01-20"): (2, 2), ("absent", "unknown"): (1, 1), ("later", f"{late:%Y-%m-%d}"): (1, 1)}
