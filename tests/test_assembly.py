"""Lookups counted inside the job that runs them, and the assembled table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duelframe.keys import Keys
from duelframe.operators import joins
from duelframe.operators.checks import RowCounts, RowsChanged

K = Keys()
D = dt.date(2020, 1, 1)
ROW = "side string, opp string, d date"


def test_counts_come_with_the_job(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    once, twice = spark.createDataFrame([(1, "a"), (9, "b")], "k int, v string"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    guard = RowCounts()
    out = guard.around(left, lambda df: joins.left_lookup(df, once, ["k"], ["k"]), "once")
    assert out.count() == 3 and guard.verify() == {"once": 3}
    guard = RowCounts()
    guard.around(left, lambda df: joins.left_lookup(df, twice, ["k"], ["k"]), "twice").write.format("noop").mode("overwrite").save()
    with pytest.raises(RowsChanged, match="twice: 3 rows became 4"):
        guard.verify()


def parts(spark, repeated_map=False, repeated_price=False):
    canon = spark.createDataFrame([("c", "x", "y", D), ("c", "y", "x", D), ("e", "x", "z", D)], "contest string, " + ROW)
    stats = spark.createDataFrame([("sx", "sy", D, 5), ("sq", "sr", D, 7)], ROW + ", q int")
    stats_map = spark.createDataFrame([("sx", "sy", D, "x", "y", D)] * (1 + repeated_map), "side_stats string, opp_stats string, d_stats date, " + ROW)
    prices = spark.createDataFrame([("px", "py", D, 1.5), ("px2", "py", D, None)], ROW + ", v double")
    price_map = spark.createDataFrame([("px", "py", D, "x", "y", D), ("px2", "py", D, "x", "y", D)], "side_prices string, opp_prices string, d_prices date, " + ROW)
    upcoming = spark.createDataFrame([("sx", "sz", dt.date(2030, 1, 1))], ROW)
    return canon, stats, stats_map, prices, price_map, upcoming, spark.createDataFrame([("sx", "x"), ("sz", "z")], "a string, id string")


def test_assembled_rows(spark):
    out, counts = joins.assemble(*parts(spark), K)
    rows = sorted((r.contest, r.side, r.q_stats, r.v_prices, r.is_dup, r.is_upcoming) for r in out.fillna(-1.0, ["v_prices"]).fillna(-1, ["q_stats"]).collect())
    assert rows == [("2020-01-01_x_y", "x", 5, -1.0, True, False), ("2020-01-01_x_y", "x", 5, 1.5, True, False), ("2020-01-01_x_y", "y", -1, -1.0, False, False),
                    ("2020-01-01_x_z", "x", -1, -1.0, False, False), ("2030-01-01_x_z", "x", -1, -1.0, False, True)]
    assert counts["statistics"] == 3
    assert [(r.side, r.v_prices) for r in joins.best_rows(out, K).where("contest = '2020-01-01_x_y'").orderBy("side").collect()] == [("x", 1.5), ("y", None)]


def test_a_repeated_key_raises(spark):
    with pytest.raises(RowsChanged):
        joins.assemble(*parts(spark, repeated_map=True), K)
    canon, *rest = parts(spark)
    with pytest.raises(RowsChanged, match="do not explain"):
        joins.assemble(canon.unionAll(canon.where(F.col("side") == "y")), *rest, K)


def test_unknown_upcoming_entity_raises(spark):
    *most, _ = parts(spark)
    with pytest.raises(Exception, match="unknown entity"):
        joins.assemble(*most, spark.createDataFrame([("sx", "x")], "a string, id string"), K)
