"""Aggregations."""

from pyspark.sql import functions as F

from ..operators import aggs
from .q_rows import HOLES, _holes
from .registry import query, r
from .standin import contests, day, dbl_sql, priced, priced_sql, raw_contests, raw_sql, rd, table, with_outcome

_RAW_HOLES = HOLES.replace("FROM dbl", "FROM raw")


@query("A1_first_nonnull_by_key", raw_sql(f"""SELECT contest, side, arg_min(v, {{'a': event, 'b': line, 'c': side_v}}) FILTER (WHERE v IS NOT NULL) AS v,
arg_min(q, {{'a': event, 'b': line, 'c': side_v}}) FILTER (WHERE q IS NOT NULL) AS q FROM {_RAW_HOLES} GROUP BY contest, side"""))
def a1(spark, sf):
    df = _holes(raw_contests(spark, sf)).select("contest", "side", "event", "line", "side_v", "v", "q")
    return aggs.first_nonnull_by_key(df, ["contest", "side"], ["event", "line", "side_v"]).select("contest", "side", "v", "q")


@query("A2_first_last_by_key", """SELECT user_id, event_type, arg_min(value, {'a': ts, 'b': event_id}) AS first_value,
arg_max(value, {'a': ts, 'b': event_id}) AS last_value FROM events GROUP BY ALL""")
def a2(spark, sf):
    return aggs.first_last_by_key(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query("A3_count_distinct_per_key", raw_sql("SELECT side, CAST(d AS VARCHAR) AS d, count(DISTINCT opp) AS n_distinct FROM raw GROUP BY ALL"))
def a3(spark, sf):
    return aggs.count_distinct_per_key(raw_contests(spark, sf), ["side", "d"], "opp").withColumn("d", day("d"))


@query("A4_value_counts", dbl_sql("SELECT cls, flag, y, count(*) AS n FROM (SELECT *, CASE res WHEN 'W' THEN 1 WHEN 'L' THEN 0 END AS y FROM dbl) WHERE y IS NOT NULL GROUP BY ALL"))
def a4(spark, sf):
    return aggs.value_counts(with_outcome(contests(spark, sf)), ["cls", "flag", "y"])


@query("A5_histogram_of_counts", raw_sql("SELECT n, count(*) AS n_keys FROM (SELECT contest, count(*) AS n FROM raw GROUP BY contest) GROUP BY n"))
def a5(spark, sf):
    return aggs.histogram_of_counts(raw_contests(spark, sf), ["contest"])


@query("A6_pooled_rate_logit", dbl_sql(f"""SELECT {r('ln(p / (1 - p))')} AS logit_rate FROM (SELECT
(sum(CASE WHEN v IS NOT NULL THEN least(side_q, opp_q) END) + sum(CASE WHEN q IS NOT NULL THEN least(side_q, z) END)) /
(sum(CASE WHEN v IS NOT NULL THEN side_q + opp_q END) + sum(CASE WHEN q IS NOT NULL THEN side_q + z END)) AS p FROM {HOLES})"""))
def a6(spark, sf):
    df = _holes(contests(spark, sf)).select(
        F.expr("CASE WHEN v IS NOT NULL THEN least(side_q, opp_q) END").alias("y1"), (F.col("side_q") + F.col("opp_q")).alias("n1"),
        F.least("side_q", "z").alias("y2"), F.expr("CASE WHEN q IS NOT NULL THEN side_q + z END").alias("n2"))
    return aggs.pooled_rate_logit(df, ["y1", "y2"], ["n1", "n2"]).select(rd("logit_rate").alias("logit_rate"))


@query("A7_sum_by_period", dbl_sql(f"SELECT CAST(d AS VARCHAR) AS d, {r('sum(side_q)', 2)} AS sum_side_q, max(side_v) AS max_side_v FROM dbl GROUP BY d"))
def a7(spark, sf):
    return aggs.sum_by_period(contests(spark, sf), "d", ["side_q"], ["side_v"]).select(day("d").alias("d"), rd("sum_side_q", 2).alias("sum_side_q"), "max_side_v")


@query("A8_group_stddev", dbl_sql(f"""SELECT contest, side, {r('side_v / sg', 4)} AS by_class, {r('side_v / sa', 4)} AS overall FROM
(SELECT *, stddev_samp(side_v) OVER (PARTITION BY cls) AS sg, stddev_samp(side_v) OVER () AS sa FROM dbl)"""))
def a8(spark, sf):
    df = contests(spark, sf).select("contest", "side", "cls", "side_v")
    by_class = aggs.group_stddev(df, ["side_v"], "cls").withColumnRenamed("side_v_scaled", "by_class")
    return aggs.group_stddev(by_class, ["side_v"]).select("contest", "side", rd("by_class", 4).alias("by_class"), rd("side_v_scaled", 4).alias("overall"))


@query("A9_rms_scale", dbl_sql(f"SELECT {r('sqrt(avg(side_v * side_v))', 3)} AS rms_side_v, {r('sqrt(avg(side_q * side_q))')} AS rms_side_q FROM dbl"))
def a9(spark, sf):
    out = aggs.rms_scale(contests(spark, sf), ["side_v", "side_q"])
    return out.select(rd("rms_side_v", 3).alias("rms_side_v"), rd("rms_side_q").alias("rms_side_q"))


_NULLS = "CAST(v IS NULL AS INT) + CAST(q IS NULL AS INT) + CAST(z IS NULL AS INT)"


@query("A10_dedupe_best_row", raw_sql(f"""SELECT contest, side, v, q, z, event FROM (SELECT *, row_number() OVER (PARTITION BY contest
ORDER BY {_NULLS}, side, v NULLS FIRST, q NULLS FIRST, z NULLS FIRST, event) AS rn FROM {_RAW_HOLES}) WHERE rn = 1"""))
def a10(spark, sf):
    return aggs.dedupe_best_row(_holes(raw_contests(spark, sf)).select("contest", "side", "v", "q", "z", "event"), ["contest"])


@query("A11_dedupe_exact", raw_sql("SELECT DISTINCT side, opp, CAST(d AS VARCHAR) AS d FROM raw"))
def a11(spark, sf):
    return aggs.dedupe_exact(raw_contests(spark, sf).select("side", "opp", day("d").alias("d")))


@query("A11_dedupe_by_key", raw_sql("""SELECT event, contest, side_v FROM (SELECT *, row_number() OVER (PARTITION BY event
ORDER BY side_v, contest) AS rn FROM raw) WHERE rn = 1"""))
def a11_key(spark, sf):
    return aggs.dedupe_by_key(raw_contests(spark, sf).select("event", "contest", "side_v"), ["event"], ["side_v"])


@query("A12_mark_duplicates", raw_sql("SELECT contest, side, event, CAST(count(*) OVER (PARTITION BY contest) > 1 AS INT) AS is_dup FROM raw"))
def a12(spark, sf):
    out = aggs.mark_duplicates(raw_contests(spark, sf).select("contest", "side", "event"), ["contest"])
    return out.withColumn("is_dup", F.col("is_dup").cast("int"))
