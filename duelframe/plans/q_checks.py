"""Data-quality checks over tables that do and do not satisfy them."""

from pyspark.sql import functions as F

from ..operators import checks as Q
from .q_rows import HOLES, _holes
from .registry import query
from .standin import contests, day, dbl_sql, raw_contests, raw_sql, table


@query("Q1_exactly_n_per_key", raw_sql("SELECT contest, count(*) AS n FROM raw GROUP BY contest HAVING count(*) <> 1"))
def q1(spark, sf):
    return Q.exactly_n_per_key(raw_contests(spark, sf), ["contest"], 1).unionByName(Q.exactly_n_per_key(contests(spark, sf), ["contest"], 2))


@query("Q2_at_most_n_per_key", raw_sql("SELECT side, CAST(d AS VARCHAR) AS d, count(*) AS n FROM raw GROUP BY ALL HAVING count(*) > 2"))
def q2(spark, sf):
    return Q.at_most_n_per_key(raw_contests(spark, sf), ["side", "d"], 2).withColumn("d", day("d"))


@query("Q3_row_count_preserved", raw_sql("SELECT (SELECT count(*) FROM raw) AS n_before, (SELECT 2 * count(DISTINCT contest) FROM raw) AS n_after"))
def q3(spark, sf):
    return Q.row_count_preserved(raw_contests(spark, sf), contests(spark, sf))


@query("Q4_no_nulls", dbl_sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_null FROM {HOLES} WHERE {c} IS NULL HAVING count(*) > 0" for c in ("v", "q", "z"))))
def q4(spark, sf):
    return Q.no_nulls(_holes(contests(spark, sf)), ["v", "q", "z"])


@query("Q5_functional_dependency", """SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""")
def q5(spark, sf):
    return Q.functional_dependency(table(spark, sf, "lineitem"), ["l_partkey"], ["l_suppkey"])


@query("Q6_not_all_null", dbl_sql(f"SELECT contest, side FROM {HOLES} WHERE v IS NULL AND q IS NULL"))
def q6(spark, sf):
    return Q.not_all_null(_holes(contests(spark, sf)), ["v", "q"]).select("contest", "side")


@query("Q7_duplicates_explained", raw_sql("SELECT contest, event, line FROM (SELECT *, count(*) OVER (PARTITION BY contest) AS n FROM raw) WHERE n > 1 AND flag <> 'R'"))
def q7(spark, sf):
    df = raw_contests(spark, sf).select("contest", "event", "line", (F.col("flag") == "R").alias("known"))
    return Q.duplicates_explained(df, ["contest"], "known").drop("known")


@query("Q8_cardinality_agreement", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P') AS n_a, (SELECT count(*) FROM customer) AS n_b")
def q8(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return Q.cardinality_agreement(orders, table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id")
