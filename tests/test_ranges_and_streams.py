"""Rows looked at over ranges whatever their keys, streams, hooks and file checks."""

import datetime as dt
import itertools
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import quality, search, vectors
from newsloom.operators.ranking import Ordered, grouped_row_number
from newsloom.plans import misc_queries, quality_queries
from newsloom.runtime import Scratch
from newsloom.streaming.twins import running_history

T0 = dt.datetime(2016, 1, 1)


@pytest.fixture
def many_ranges(spark):
    """Small tables are cut into as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def hot(n=3000):
    """One key has 90 % of the rows; one of its times lies far away."""
    rng = random.Random(1)
    return [(1 if i % 10 else 2 + i % 7, 10**9 if i == 11 else rng.randrange(500), i, rng.randrange(3)) for i in range(n)]


def test_neighbours_and_sums_of_a_hot_key(spark, many_ranges):
    rows = hot()
    df = spark.createDataFrame(rows, "k bigint, t bigint, i bigint, v bigint")
    o = Ordered(df, ["k"], ["t", "i"], Scratch(spark, "t"))
    assert o.rows.groupBy("__p").count().agg(F.max("count")).first()[0] < 1000 and o.rows.where("k = 1").select("__p").distinct().count() > 5
    got = {r["i"]: (r["prev_t"], r["prev_v"], r["s"]) for r in o.before(["t", "v"]).running("v", "s").rows.collect()}
    want = {}
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2])), key=lambda r: r[0]):
        before, s = (None, None), 0
        for _, t, i, v in own:
            s += v
            want[i] = (*before, s)
            before = (t, v)
    assert got == want
    assert Ordered(df.limit(0), ["k"], ["t", "i"], Scratch(spark, "t")).before(["v"]).running("v", "s").rows.isEmpty()


def test_numbers_within_groups_of_any_size(spark, many_ranges):
    rows = [*[(k if k != 3 else None, t, i) for k, t, i, _ in hot(900)]]
    df = spark.createDataFrame(rows, "k bigint, t bigint, i bigint")
    got = {r["i"]: r["n"] for r in grouped_row_number(df, ["k"], [F.desc("t"), "i"], "n", Scratch(spark, "t")).collect()}
    want = {}
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])), key=lambda r: r[0]):
        want |= {i: n for n, (_, _, i) in enumerate(own, 1)}
    assert got == want


def test_sessions_and_disorder_of_a_hot_user(spark, many_ranges, tmp_path):
    rng = random.Random(5)
    rows = [(i, 1 if i % 10 else 2, T0 + dt.timedelta(minutes=rng.randrange(9000) if i != 7 else 10**6)) for i in range(1500)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["user_id"], r["session"]): (r["n_events"], r["first_ts"]) for r in misc_queries.user_sessions(spark, str(tmp_path)).collect()}
    want = {}
    for u in (1, 2):
        n, last = 0, None
        for t in sorted(t for _, x, t in rows if x == u):
            if last is None or t - last > dt.timedelta(minutes=30):
                n += 1
                want[u, n] = (0, t)
            want[u, n] = (want[u, n][0] + 1, want[u, n][1])
            last = t
    assert got == want
    b = spark.createDataFrame([(i, u, t) for i, u, t in rows], "impression_id bigint, user_id bigint, impression_time timestamp_ntz")
    falls = sum(b[2] < a[2] for u in (1, 2) for a, b in itertools.pairwise(r for r in rows if r[1] == u))
    assert quality.time_disorder(b, Scratch(spark, "t")).first()["falling_pairs"] == falls


def test_streamed_histories(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    event = lambda u, i, m, cur, clicks: json.dumps({"user_id": u, "impression_id": i, "event_time": str(T0 + dt.timedelta(minutes=m)), "current": cur, "clicks": clicks})
    (src / "a.json").write_text("\n".join([event(1, 2, 5, 30, [40, 50]), event(1, 1, 0, 10, [20]), event(2, 3, 1, None, [7])]))
    (src / "b.json").write_text("\n".join([event(1, 4, 30, 50, []), event(2, 5, 40, 8, [9]), event(9, 9, 600, 1, [])]))
    schema = "user_id bigint, impression_id bigint, event_time timestamp, current bigint, clicks array<bigint>"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = running_history(stream).writeStream.format("memory").queryName("histories").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r["impression_id"]: (r["user_id"], r["history"], r["clicks"]) for r in spark.table("histories").collect()}
    assert {k: v for k, v in got.items() if k != 9} == {1: (1, [10], [20]), 2: (1, [10, 20, 30], [40, 50]), 4: (1, [10, 20, 30, 40, 50], []), 3: (2, [], [7]), 5: (2, [7, 8], [9])}


def test_files_that_cannot_be_read(spark, tmp_path):
    for name in ("behaviors", "history"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    got = {r["table_name"]: r for r in quality_queries.file_validation(spark, str(tmp_path)).collect()}
    assert (got["articles"]["status"], got["articles"]["row_count"], got["articles"]["missing_columns"]) == ("FAIL", None, "PATH_NOT_FOUND")
    assert got["history"]["status"] == "PASS" and got["history"]["row_count"] > 0
    data = bytearray(Path("/root/testdata/sf0.001/articles.parquet").read_bytes())
    data[200:6000] = bytes(5800)  # the footer is whole, the values aren't
    (tmp_path / "articles.parquet").write_bytes(data)
    (tmp_path / "history.parquet").unlink()
    spark.createDataFrame([(1,)], "user_id bigint").write.parquet(f"{tmp_path}/history.parquet")
    got = {r["table_name"]: r for r in quality_queries.file_validation(spark, str(tmp_path)).collect()}
    assert got["articles"]["status"] == "FAIL" and got["articles"]["row_count"] is None
    assert got["history"]["status"] == "FAIL" and "article_id_fixed" in got["history"]["missing_columns"]


def test_a_decision_function_on_the_workers(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, "")], "article_id bigint, entity_keys string")
    out = search.decided(df, lambda rows: [(r["article_id"], k, "UNLINKED") for r in rows for k in r["entity_keys"].split("|") if k], "article_id bigint, canonical_entity_key string, decision string")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "UNLINKED"), (1, "b", "UNLINKED")]
    assert search.decided(df.limit(0), lambda rows: [], "x bigint").isEmpty()
    assert spark.range(1).select(search.token_cost(F.lit(2e6), F.lit(1e6), F.lit(1e6)).alias("c")).first()["c"] == pytest.approx(0.25 + 0.025 + 2)


def test_text_helpers(spark):
    df = spark.createDataFrame([("12", "–"), ("x", "​"), (None, None)], "a string, ch string")
    r = df.select(text.loose_cast(F.col("a"), "int").alias("n"), text.character_name("ch").alias("name"), text.content_key(F.col("a"), F.lit("da")).alias("k"), text.truncated(F.lit("abc def"), 4).alias("t"), text.truncated(F.lit("abc"), 3).alias("u")).collect()
    assert [x["n"] for x in r] == [12, None, None] and [x["name"] for x in r] == ["EN DASH", "ZERO WIDTH SPACE", None]
    assert len({x["k"] for x in r}) == 3 and len(r[0]["k"]) == 64 and (r[0]["t"], r[0]["u"]) == ("abc …", "abc")


def test_vectors_that_cannot_be_used_are_an_error(spark):
    schema = "row bigint, v array<float>"
    good = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], schema)
    assert vectors.require_vectors(good, "row", "v", 2, 2) is good
    for rows in ([(0, [1.0, 1.0])], [(0, None)], [(0, [1.0])], [(0, [float("nan"), 0.0])], [(1, [1.0, 0.0])], [(0, [1.0, 0.0]), (0, [1.0, 0.0])]):
        with pytest.raises(ValueError):
            vectors.require_vectors(spark.createDataFrame(rows, schema), "row", "v", 2)
    with pytest.raises(ValueError):
        vectors.require_vectors(good, "row", "v", 2, 3)
    with pytest.raises(ValueError):
        vectors.require_vectors(spark.createDataFrame([(0, [1.0])], "row bigint, v array<double>"), "row", "v", 1)
