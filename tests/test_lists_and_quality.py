"""Array expressions and validation on the worked examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import lists
from newsloom.functions.text import entity_text, strip
from newsloom.operators import quality as Q

T0 = dt.datetime(2016, 1, 20)
B = "impression_id bigint, user_id bigint, impression_time timestamp_ntz, article_id int, article_ids_clicked array<int>, article_ids_inview array<int>"
H = "user_id bigint, impression_time_fixed array<timestamp_ntz>, article_id_fixed array<int>, scroll_percentage_fixed array<float>, read_time_fixed array<float>"


def test_stable_unique(spark):
    df = spark.createDataFrame([([100, None, 200],), ([100, 100, 200, 100],), ([],), (None,)], "x array<int>")
    assert [r[0] for r in df.select(lists.stable_unique("x")).collect()] == [[100, 200], [100, 200], [], []]
    assert [r[0] for r in df.select(lists.stable_unique_keeping_null("x")).collect()] == [[100, None, 200], [100, 200], [], []]


def test_labels(spark):
    df = spark.createDataFrame([([100, 200, 300, 400], [100, 300])], "c array<int>, t array<int>")
    assert df.select(lists.labels(F.col("c"), F.col("t"))).first()[0] == [1, 0, 1, 0]


def test_text_forms(spark):
    df = spark.createDataFrame([(" Ａ  Ærø B ",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(entity_text(F.col("s"))).collect()] == ["a ærø b", None, ""]
    assert df.select(strip(F.col("s"))).first()[0] == "Ａ  Ærø B"


def test_usable_flags(spark):
    rows = [
        (1, 1, T0, None, [5], [5, 6]), (2, 1, T0, 7, [None], [5]), (3, 1, T0, 7, None, [5]), (4, None, T0, 7, [5], [5]), (5, 1, None, 7, [5], [5]),
        (6, 1, T0, 7, [5], []), (7, 1, T0, 7, [9], [5]), (8, 1, T0, 7, [5], [5]), (8, 1, T0, 7, [5], [5]), (None, 1, T0, 7, [5], [5]),
    ]
    b = spark.createDataFrame(rows, B)
    assert sorted(r[0] for r in Q.usable_flags(b, False).where("usable").select("impression_id").collect()) == [1, 6, 7]
    assert sorted(r[0] for r in Q.usable_flags(b, True).where("usable").select("impression_id").collect()) == [1]


def test_history_validation(spark):
    h = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [
        (1, [h(0), h(1), None, h(3)], [100, None, 300, 400], [], []), (2, [h(3), h(1)], [1, 2], [], []), (3, [h(3)], [1, 2], [], []), (3, [h(3)], [1], [], []), (None, [h(3)], [1], [], []), (4, None, [1], [], []), (5, [], [], [], []),
    ]
    r = Q.history_validation(spark.createDataFrame(rows, H)).first().asDict()
    assert r == {"row_count": 7, "null_user_rows": 1, "dup_user_rows": 2, "null_list_rows": 1, "mismatch_rows": 1, "null_element_rows": 1, "excluded_rows": 4, "usable_rows": 3, "reorder_rows": 1}


def test_empty_tables(spark):
    b, h = spark.createDataFrame([], B), spark.createDataFrame([], H)
    assert Q.history_validation(h).first()["row_count"] == 0
    assert Q.behavior_profile(b).first()["row_count"] == 0
    assert Q.null_profile(b).count() == 6
    assert Q.user_overlap(h, b).first()[0] == 0


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="lacks the columns b, c"):
        Q.ensure_columns(df, ["c", "a", "b"], "t")


def test_numeric_summary(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    r = df.agg(*Q.numeric_summary(F.col("x"))).first()
    assert (r["min"], r["mean"], r["median"], r["max"], r["p25"]) == (1.0, 4.0, 2.5, 10.0, 1.75)
