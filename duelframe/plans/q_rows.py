"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from ..operators import rows
from .registry import query, r
from .standin import K, PAIRS, contests, day, dbl_sql, raw_contests, raw_sql, rd, table, with_outcome

# Map tables are derived from the given tables so that they grow with them.
CLASS_POUNDS = "CASE cls WHEN '1-URGENT' THEN 265 WHEN '2-HIGH' THEN 205 WHEN '3-MEDIUM' THEN 170 WHEN '5-LOW' THEN 125 END"


def class_map(spark, sf):
    return table(spark, sf, "orders").select("o_orderpriority").distinct().select(
        F.col("o_orderpriority").alias("cls"), F.expr(CLASS_POUNDS.replace("cls", "o_orderpriority")).alias("pounds")
    ).where("pounds is not null")


@query("P1_swap_sides", raw_sql("SELECT contest, opp AS side, side AS opp, opp_v AS side_v, side_v AS opp_v, opp_q AS side_q, side_q AS opp_q FROM raw"))
def p1(spark, sf):
    df = raw_contests(spark, sf).select("contest", "side", "opp", "side_v", "opp_v", "side_q", "opp_q")
    return rows.swap_sides(df, PAIRS)


@query("P2_flip_outcome", dbl_sql(f"""SELECT contest, side, CASE res WHEN 'W' THEN 'L' WHEN 'L' THEN 'W' ELSE res END AS wld,
CASE WHEN lower(res) = 'w' THEN 'loss' WHEN res = 'L' THEN 'loss' ELSE 'draw' END AS win_loss,
1 - CASE res WHEN 'W' THEN 1 WHEN 'L' THEN 0 END AS bin, {r('opp_v - side_v', 2)} AS sgn FROM dbl"""))
def p2(spark, sf):
    df = with_outcome(contests(spark, sf)).withColumn("word", F.expr("CASE res WHEN 'W' THEN 'win' WHEN 'L' THEN 'loss' ELSE 'draw' END"))
    return df.select("contest", "side", rows.flip_outcome("res").alias("wld"), rows.flip_outcome("word", "win_loss").alias("win_loss"),
                     rows.flip_outcome("y", "binary").alias("bin"), rd(rows.flip_outcome(F.col("side_v") - F.col("opp_v"), "sign"), 2).alias("sgn"))


@query("P3_map_values", dbl_sql(f"SELECT contest, side, {CLASS_POUNDS} AS pounds FROM dbl"))
def p3(spark, sf):
    return rows.map_values(contests(spark, sf), "cls", class_map(spark, sf), out="pounds").select("contest", "side", "pounds")


@query("P4_overwrite_values", dbl_sql("""SELECT contest, coalesce(a.s_name, side) AS side, coalesce(b.s_name, opp) AS opp,
side AS side_pre_overwrite, opp AS opp_pre_overwrite FROM dbl
LEFT JOIN supplier a ON side = CAST(a.s_suppkey AS VARCHAR) AND a.s_acctbal < 0
LEFT JOIN supplier b ON opp = CAST(b.s_suppkey AS VARCHAR) AND b.s_acctbal < 0"""))
def p4(spark, sf):
    names = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string"), "s_name")
    return rows.overwrite_values(contests(spark, sf).select("contest", "side", "opp"), ["side", "opp"], names)


@query("P5_drop_listed_pairs", dbl_sql("""SELECT contest, side, opp FROM dbl WHERE contest NOT IN
(SELECT contest FROM raw WHERE side_q = opp_q)"""))
def p5(spark, sf):
    listed = raw_contests(spark, sf).where("side_q = opp_q").select("d", "opp", "side")
    return rows.drop_listed_pairs(contests(spark, sf), listed).select("contest", "side", "opp")


@query("P6_drop_listed_keys", dbl_sql("SELECT contest, side FROM dbl WHERE event NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"))
def p6(spark, sf):
    listed = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return rows.drop_listed_keys(contests(spark, sf), listed, "event").select("contest", "side")


def _holes(df):
    """Contests with missing stats: draws have no value, returned lines no quantity."""
    return df.withColumns({"v": F.expr("CASE WHEN res <> 'D' THEN side_v END"), "q": F.expr("CASE WHEN flag <> 'R' THEN side_q END"),
                           "z": F.expr("CASE WHEN method = 'F' THEN 0.0 ELSE opp_q END")})


HOLES = "(SELECT *, CASE WHEN res <> 'D' THEN side_v END AS v, CASE WHEN flag <> 'R' THEN side_q END AS q, CASE WHEN method = 'F' THEN 0.0 ELSE opp_q END AS z FROM dbl)"


@query("P7_dropna_subset", dbl_sql(f"SELECT contest, side, v, q FROM {HOLES} WHERE v IS NOT NULL AND q IS NOT NULL"))
def p7(spark, sf):
    return rows.dropna_subset(_holes(contests(spark, sf)), ["v", "q"]).select("contest", "side", "v", "q")


@query("P8_keep_complete_or_flag", dbl_sql(f"SELECT contest, side, v, q FROM {HOLES} WHERE (v IS NOT NULL AND q IS NOT NULL) OR method = 'F'"))
def p8(spark, sf):
    return rows.keep_complete_or_flag(_holes(contests(spark, sf)), ["v", "q"], F.col("method") == "F").select("contest", "side", "v", "q")


@query("P9_row_null_share", dbl_sql(f"""SELECT contest, side, {r('(CAST(v IS NULL AS INT) + CAST(q IS NULL AS INT) + CAST(z IS NULL AS INT)) / 3.0')} AS null_share FROM {HOLES}"""))
def p9(spark, sf):
    return _holes(contests(spark, sf)).select("contest", "side", rd(rows.row_null_share(["v", "q", "z"])).alias("null_share"))


@query("P10_row_zero_share", dbl_sql(f"""SELECT contest, side,
{r('(CAST(coalesce(v, 0) = 0 AS INT) + CAST(coalesce(q, 0) = 0 AS INT) + CAST(coalesce(z, 0) = 0 AS INT)) / 3.0')} AS zero_share,
CAST(v IS NULL AND q IS NULL AS INT) AS all_null FROM {HOLES}"""))
def p10(spark, sf):
    return _holes(contests(spark, sf)).select("contest", "side", rd(rows.row_zero_share(["v", "q", "z"])).alias("zero_share"),
                                              rows.row_all_null(["v", "q"]).cast("int").alias("all_null"))


@query("P11_fill_from", dbl_sql(f"SELECT contest, side, coalesce(v, opp_v) AS v, coalesce(q, side_q) AS q FROM {HOLES}"))
def p11(spark, sf):
    return rows.fill_from(_holes(contests(spark, sf)), {"v": "opp_v", "q": "side_q"}).select("contest", "side", "v", "q")


@query("P12_is_member", dbl_sql("""SELECT contest, side, CAST(side IN (SELECT side FROM dbl WHERE cls = '1-URGENT' AND flag = 'R' AND side_q = 50)
OR opp IN (SELECT side FROM dbl WHERE cls = '1-URGENT' AND flag = 'R' AND side_q = 50) AS INT) AS flagged FROM dbl"""))
def p12(spark, sf):
    df = contests(spark, sf)
    ids = df.where("cls = '1-URGENT' and flag = 'R' and side_q = 50").select("side")
    return rows.is_member(df, ids, ["side", "opp"], "hit").select("contest", "side", F.col("hit").cast("int").alias("flagged"))


@query("P13_date_query", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'""")
def p13(spark, sf):
    return rows.date_query(table(spark, sf, "orders"), "o_orderdate", "1995-01-01", "1997-01-01", o_orderstatus="F").select("o_orderkey", "o_totalprice")


_AUDITED = ["contest", "side", "v", "q", "z", "res"]


@query("P14_column_audit", dbl_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n_present, {r(f'1 - count({c}) / count(*)')} AS null_share FROM {HOLES}" for c in _AUDITED)))
def p14(spark, sf):
    return rows.column_audit(_holes(contests(spark, sf)).select(*_AUDITED)).withColumn("null_share", rd("null_share"))
