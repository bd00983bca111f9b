"""Sorts, limits and set operations."""

from pyspark.sql import functions as F

from ..operators import sets
from .registry import query
from .standin import day, raw_contests, raw_sql, table


@query("O1_sort_stable", raw_sql("SELECT CAST(d AS VARCHAR) AS d, contest, side, event, line, side_v FROM raw ORDER BY d, contest, side, event, line, side_v"))
def o1(spark, sf):
    df = raw_contests(spark, sf).select("d", "contest", "side", "event", "line", "side_v")
    return sets.sort_stable(df, ["d"], ["contest", "side", "event", "line", "side_v"]).withColumn("d", day("d"))


@query("O2_top_n", raw_sql("SELECT side, opp, count(*) AS n FROM raw GROUP BY ALL ORDER BY n DESC, side, opp LIMIT 10"))
def o2(spark, sf):
    counts = raw_contests(spark, sf).groupBy("side", "opp").agg(F.count(F.lit(1)).alias("n"))
    return sets.top_n(counts, [F.desc("n"), "side", "opp"], 10)


@query("O3_union_all_by_name", """SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_mktsegment AS segment, NULL AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def o3(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return sets.union_all_by_name(a, b)


def _ids(spark, sf, method):
    return raw_contests(spark, sf).where(F.col("method") == method).select("contest", "side")


@query("O4_set_union", raw_sql("SELECT contest, side FROM raw WHERE method = 'F' UNION SELECT contest, side FROM raw WHERE method = 'O'"))
def o4_union(spark, sf):
    return sets.set_union(_ids(spark, sf, "F"), _ids(spark, sf, "O"))


@query("O4_set_difference", raw_sql("SELECT contest, side FROM raw WHERE method = 'F' EXCEPT SELECT contest, side FROM raw WHERE method = 'O'"))
def o4_diff(spark, sf):
    return sets.set_difference(_ids(spark, sf, "F"), _ids(spark, sf, "O"))


@query("O5_key_intersection", raw_sql("""SELECT a.side, a.x AS x_a, b.x AS x_b FROM (SELECT side, max(cls || event) AS x FROM raw WHERE flag = 'R' GROUP BY side) a
JOIN (SELECT side, max(cls || event) AS x FROM raw WHERE flag = 'A' GROUP BY side) b ON a.side = b.side WHERE a.x <> b.x"""))
def o5(spark, sf):
    df = raw_contests(spark, sf).withColumn("x", F.concat("cls", F.col("event").cast("string")))
    part = lambda flag: df.where(F.col("flag") == flag).groupBy("side").agg(F.max("x").alias("x"))
    return sets.key_intersection(part("R"), part("A"), "side", "x")
