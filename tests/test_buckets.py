import re

import pytest
from pyspark.sql import functions as F

from duelframe.operators.joins import attach_both_sides
from duelframe.plans import load_all
from duelframe.plans.flagship import career_edges
from duelframe.session import bucketed

QUERIES, _ = load_all()


@pytest.fixture
def no_broadcast(spark):
    """Tables of the size they have on a cluster are not broadcast by themselves."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    return re.findall(r"Exchange (\w+\([^)]*\))", plan)


@pytest.mark.parametrize("name", ["J2_attach_both_sides", "J15_feature_join"])
def test_no_shuffle_above_bucketed_tables(spark, sf, no_broadcast, name):
    assert shuffles(QUERIES[name](spark, sf)) == []


def test_the_flagship_shuffles_only_totals_of_days(spark, sf, no_broadcast):
    found = [s for s in shuffles(career_edges(spark, sf)) if s.startswith("hashpartitioning")]
    assert found and all(s.startswith("hashpartitioning(d#") for s in found)


def test_bucketed_rows_are_the_rows(spark, no_broadcast):
    df = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("contest"), F.col("id").alias("side"),
                                  (F.col("id") + 1).alias("opp"), F.lit(None).cast("string").alias("note"))
    table = bucketed(df, "contest", "rows", 3)
    assert sorted(map(str, table.collect())) == sorted(map(str, df.collect()))
    assert bucketed(df.limit(0), "contest", "none").collect() == []
    right = table.where("contest is not null").groupBy("contest", "side").agg(F.count("*").alias("n"))
    got = attach_both_sides(table, right, "contest", bucket="contest")
    assert shuffles(got) == []
    plain = attach_both_sides(df, df.where("contest is not null").groupBy("contest", "side").agg(F.count("*").alias("n")), "contest")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
