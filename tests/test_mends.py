"""Rows that used to give wrong answers: third outcomes, prices without odds, late rows, half-done swaps, odd links."""

import datetime as dt

import pytest

from duelframe.functions.odds import contest_duration
from duelframe.keys import Keys
from duelframe.operators import bets, careers, joins, validate
from duelframe.session import new_path
from duelframe.sources import pages, tables


def test_a_draw_is_not_the_opponent(spark):
    rows = [("k", "a", "b", o, p) for o, p in (("a", 1.5), ("b", 2.5), ("Draw", 51.0))] + [("l", "a", "b", "a", 1.0), ("l", "a", "b", "Draw", 9.0)]
    df = spark.createDataFrame(rows, "key string, side string, opp string, outcome string, price double")
    assert [tuple(r) for r in joins.outcome_pivot_join(df, ["key", "side", "opp"], "outcome", "price").collect()] == [("k", "a", "b", 1.5, 2.5)]


def test_tolerant_join_refuses_to_repeat_right_rows(spark):
    df = spark.createDataFrame([("x", dt.date(2020, 1, 1))], "a string, d date")
    for how in ("right", "full", "outer"):
        with pytest.raises(ValueError):
            joins.tolerant_date_join(df, df.toDF("b", "e"), [("a", "b")], "d", "e", 1, how)


def test_feature_join_refuses_clashing_names(spark):
    df = spark.createDataFrame([("c", "s", "o", 1)], "contest string, side string, opp string, x int")
    with pytest.raises(ValueError):
        joins.feature_join(df, df, Keys())
    assert joins.feature_join(df, df.withColumnRenamed("x", "y"), Keys()).collect()[0].y == 1


def test_prices_without_odds_are_no_bets(spark):
    df = spark.createDataFrame([(0.9, 1.0, 0.0, 1.0), (0.9, 0.0, 1.0, 1.0), (0.6, 0.5, 0.5, 1.0)], "p double, ps double, po double, y double")
    got = df.agg(validate.flat_return_of("p", "ps", "po", "y").alias("flat"), validate.kelly_growth_of("p", "ps", "po", "y").alias("growth")).first()
    # The first row backs the opponent at no price, the second the side at none: only the third is a bet.
    assert got.flat == pytest.approx(1.0) and got.growth == pytest.approx(1.2)


def test_a_contest_lacking_a_price_takes_no_share(spark):
    df = spark.createDataFrame([("d", 0.6, 2.0, 2.0), ("d", 0.9, 2.0, None), ("e", 0.5, None, None)], "d string, y_pred double, side_odds double, opp_odds double")
    staked = bets.period_stakes(bets.with_kelly(df), "d").collect()
    assert [(r.d, r.n_bets) for r in staked] == [("d", 1)]


def test_career_row_of_missing_entities_is_the_same_every_time(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("c", None, day, 0, 1.0, 3), ("c", None, day, 0, 1.0, 2)], "contest string, side string, d date, flag int, duration double, cls int")
    rows = careers.career_table(df).collect()
    assert [(r.min_cls, r.max_cls) for r in rows] == [(2, 3)]


def test_long_rounds_do_not_overflow(spark):
    df = spark.createDataFrame([([999999] * 50, 50, 7)], "arr array<int>, r int, secs int")
    assert df.select(contest_duration("arr", "r", "secs")).first()[0] == 49 * 999999 * 60 + 7


def test_links_of_every_spelling(spark):
    html = """<a HREF="/a?x=1&amp;y=2">1</a><a href = '/b'>2</a><a href=/c>3</a><a data-x="/no" href="http://e/">4</a><a href="/d&amp;lt;">5</a>"""
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert [(r.pos, r.href) for r in pages.extract_links(df, "html", "/").collect()] == [(0, "/a?x=1&y=2"), (1, "/b"), (2, "/c"), (3, "/d&lt;")]


def rows_of(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).collect()))


def test_late_rows(spark):
    for late, kept in (("arrival", [("a", 3)]), ("order", [("a", 5)])):
        path = new_path(spark, "late")
        tables.upsert(spark.createDataFrame([("a", 5)], "k string, ts int"), path, ["k"], ["ts"], late=late)
        tables.upsert(spark.createDataFrame([("a", 3)], "k string, ts int"), path, ["k"], ["ts"], late=late)
        assert rows_of(spark, path) == kept


@pytest.mark.parametrize("step", ["moved away", "both there"])
def test_a_half_done_swap_loses_nothing(spark, step):
    path = new_path(spark, "swap")
    tables.upsert(spark.createDataFrame([(i, "old") for i in range(5)], "k int, v string"), path, ["k"])
    fs, target = tables._fs(spark, path)
    old = tables._old_of(spark, path)
    if step == "moved away":
        fs.rename(target, old)
    else:
        spark.read.parquet(path).limit(1).write.parquet(old.toString())
    tables.upsert(spark.createDataFrame([(9, "new")], "k int, v string"), path, ["k"])
    assert rows_of(spark, path) == [(i, "old") for i in range(5)] + [(9, "new")] and not fs.exists(old)
    tables.upsert(spark.createDataFrame([(0, "newer")], "k int, v string"), path, ["k"])
    assert rows_of(spark, path)[0] == (0, "newer") and len(rows_of(spark, path)) == 6


def test_a_null_prediction_raises(spark):
    rows = [(f"c{k}", dt.date(2020, 1, 1 + k), 0.5 if k != 5 else None) for k in range(8)]
    df = spark.createDataFrame(rows, "contest string, d date, p double")
    model = lambda train, test: test.withColumn("y_pred", test.p)
    with pytest.raises(Exception, match="a model gave a null prediction"):
        validate.walk_forward(model, df, "d", n_splits=2)
    kept = validate.walk_forward(model, df.na.fill(0.25), "d", n_splits=2).collect()
    assert kept and all(r.y_pred is not None for r in kept)


def test_few_large_groups_are_not_dealt_by_group(spark):
    """Deviations of a group meet its rows where they lie, whatever Spark thinks of sizes."""
    from duelframe.operators.aggs import group_stddev

    rows = [("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 5.0), ("b", None), ("a", 5.0)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = group_stddev(spark.createDataFrame(rows, "g string, x double"), ["x"], "g")
        got = {(r.g, r.x, r.x_scaled) for r in out.collect()}
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {("a", 1.0, 0.5), ("a", 3.0, 1.5), ("a", 5.0, 2.5), ("b", 2.0, None), ("b", None, None), (None, 5.0, None)}
