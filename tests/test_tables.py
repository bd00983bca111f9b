"""Joins, aggregates, checks and sinks on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duelframe.keys import Keys
from duelframe.operators import aggs, checks, joins, rows, sets
from duelframe.plans.standin import contests, raw_contests
from duelframe.session import new_path
from duelframe.sources import pages, tables

K = Keys()
DAY = dt.date(2020, 1, 1)


def test_doubled_has_two_rows(spark, sf):
    df = contests(spark, sf)
    assert checks.exactly_n_per_key(df, ["contest"], 2).isEmpty()
    assert df.groupBy("contest").agg(F.count_distinct("side").alias("n")).where("n <> 2").isEmpty()
    with pytest.raises(checks.CheckFailed):
        checks.raise_if_any(checks.exactly_n_per_key(raw_contests(spark, sf).unionAll(raw_contests(spark, sf)), ["contest"], 1))


@pytest.mark.parametrize("tol", [0, 1, 3, 10])
def test_tolerant_join_is_exact(spark, tol):
    left = [("a" if i % 3 else "b", DAY + dt.timedelta(days=(i * 5) % 37), i) for i in range(40)]
    right = [("a" if i % 2 else "b", DAY + dt.timedelta(days=(i * 3) % 41 - 2), i) for i in range(40)]
    l, r = spark.createDataFrame(left, "k string, d date, i int"), spark.createDataFrame(right, "k2 string, d2 date, j int")
    want = sorted((i, j) for k, d, i in left for k2, d2, j in right if k == k2 and abs((d - d2).days) <= tol)
    got = joins.tolerant_date_join(l, r, [("k", "k2")], "d", "d2", tol)
    assert sorted((x.i, x.j) for x in got.collect()) == want
    outer = joins.tolerant_date_join(l, r, [("k", "k2")], "d", "d2", tol, "left")
    assert outer.select("i").distinct().count() == 40
    spread = joins.jitter_date_join(l, r.toDF("k", "d", "j"), ["k"], "d", tol)
    assert sorted((x.i, x.j) for x in spread.collect()) == want


def test_first_nonnull_is_per_column(spark):
    df = spark.createDataFrame([("k", 1, None, "x"), ("k", 2, 5, None), ("k", 3, 6, "z")], "k string, o int, a int, b string")
    row = aggs.first_nonnull_by_key(df, ["k"], ["o"]).first()
    assert (row.a, row.b) == (5, "x")
    row = aggs.first_last_by_key(df, ["k"], ["o"], ["a", "b"]).first()
    assert (row.first_a, row.last_a, row.first_b, row.last_b) == (5, 6, "x", "z")


def test_row_helpers(spark):
    df = spark.createDataFrame([("c", "x", "y", None, 0.0, "W"), ("d", None, "z", 2.0, None, "D")], "contest string, side string, opp string, a double, b double, res string")
    got = df.select(rows.row_null_share(["a", "b"]).alias("n"), rows.row_zero_share(["a", "b"]).alias("z"), rows.flip_outcome("res").alias("f")).collect()
    assert [(r.n, r.z, r.f) for r in got] == [(0.5, 1.0, "L"), (0.5, 0.5, "D")]
    with pytest.raises(ValueError):
        rows.flip_outcome("res", "nope")
    marks = aggs.mark_duplicates(spark.createDataFrame([(None,), (None,), (1,)], "k int"), ["k"])
    assert sorted((str(r.k), r.is_dup) for r in marks.collect()) == [("1", False), ("None", True), ("None", True)]
    assert rows.side_pairs(["a_side", "a_opp", "b_side"]) == {"a_side": "a_opp"}


def test_null_safe_both_sides(spark):
    df = spark.createDataFrame([("c", None, "b")], "contest string, side string, opp string")
    right = spark.createDataFrame([("c", None, 1), ("c", "b", 2)], "contest string, side string, v int")
    row = joins.attach_both_sides(df, right, "contest", K, null_safe=True).first()
    assert (row.v, row.v_opp) == (1, 2)
    assert joins.attach_both_sides(df, right, "contest", K).first().v is None


def test_set_difference_with_nulls(spark):
    a, b = spark.createDataFrame([(1,), (None,), (2,)], "x int"), spark.createDataFrame([(None,), (2,)], "x int")
    assert [r.x for r in sets.set_difference(a, b).collect()] == [1]


def test_upsert_whole_and_partitioned(spark):
    old = spark.createDataFrame([("a", 1, "p", 1), ("b", 1, "q", 1)], "k string, v int, part string, o int")
    new = spark.createDataFrame([("a", 2, "p", 1), ("a", 3, "p", 2), ("c", 9, "p", 1)], "k string, v int, part string, o int")
    for parts in (None, ["part"]):
        path = new_path(spark, "upsert-test")
        tables.upsert(old, path, ["k", "part"], ["o"], parts)
        tables.upsert(new, path, ["k", "part"], ["o"], parts)
        assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 1), ("c", 9)]
    with pytest.raises(ValueError):
        tables.upsert(old, path, ["k"], [], ["part"])


def test_insert_ignore(spark):
    path = new_path(spark, "insert-test")
    for batch in ([("a", 1), ("a", 2)], [("a", 3), ("b", 4)]):
        tables.insert_ignore(spark.createDataFrame(batch, "k string, v int"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 4)]


def test_page_frontier(spark):
    df = spark.createDataFrame([("u1", '<a href="/f/x"></a><a href="/e/y"></a>'), ("u2", "<table></table> no stats")], "url string, html string")
    assert [r.href for r in pages.extract_links(df, "html", "/f/").collect()] == ["/f/x"]
    ok, rejects = pages.missing_stats_filter(df, "no stats", n_tables=0)
    assert ok.count() == 1 and rejects.first().reason == "marker"
