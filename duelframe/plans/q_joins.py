"""Joins."""

from pyspark.sql import functions as F

from ..operators import joins
from ..operators.sets import union_all_by_name
from ..session import bucketed, materialize
from .registry import query, r
from .standin import K, PAIRS, contests, day, dbl_sql, priced, priced_sql, raw_contests, raw_sql, rd, table


@query("J1_double_contests", dbl_sql("SELECT contest, CAST(d AS VARCHAR) AS d, side, opp, side_v, opp_v, res FROM dbl"))
def j1(spark, sf):
    return contests(spark, sf).select("contest", day("d").alias("d"), "side", "opp", "side_v", "opp_v", "res")


@query("J2_attach_both_sides", raw_sql("""
, st AS (SELECT contest, side, max(side_v) AS best, count(*) AS n FROM raw GROUP BY ALL)
SELECT raw.contest, raw.side, raw.opp, a.best, a.n, b.best AS best_opp, b.n AS n_opp FROM raw
LEFT JOIN st a ON raw.contest = a.contest AND raw.side = a.side LEFT JOIN st b ON raw.contest = b.contest AND raw.opp = b.side"""))
def j2(spark, sf):
    df = bucketed(raw_contests(spark, sf).select("contest", "side", "opp", "side_v"), "contest", "meetings")
    stats = df.groupBy("contest", "side").agg(F.max("side_v").alias("best"), F.count(F.lit(1)).alias("n"))
    return joins.attach_both_sides(df.drop("side_v"), stats, "contest", K, bucket="contest")


_ALIAS = "'a' || CAST((CAST(side AS BIGINT) * 7919) % 100003 AS VARCHAR)"


def aux_id(c):
    return F.concat(F.lit("a"), ((F.col(c).cast("bigint") * 7919) % 100003).cast("string"))


@query("J3_three_source_join", dbl_sql(f"""
SELECT contest, side, opp, CAST(d AS VARCHAR) AS d, FALSE AS is_upcoming, CASE WHEN flag <> 'N' THEN {_ALIAS} END AS side_aux,
  CASE WHEN flag = 'R' THEN side_q END AS q_aux, CASE WHEN method = 'F' THEN side_v END AS v_aux2 FROM dbl
UNION ALL SELECT NULL, CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR), '2030-01-01', TRUE, NULL, NULL, NULL FROM supplier"""))
def j3(spark, sf):
    base = [K.side, K.opp, K.date]
    # Written once: every table below is made of it.
    df = materialize(contests(spark, sf).select("contest", *base, "res", "flag", "method", "side_q", "side_v"), "contests")
    mapped = df.where("flag <> 'N'").select(*base, aux_id("side").alias("side_aux"), aux_id("opp").alias("opp_aux"),
                                           F.date_add("d", 1).alias("d_aux"), "flag", "side_q")
    aux = mapped.where("flag = 'R'").select(F.col("side_aux").alias("side"), F.col("opp_aux").alias("opp"), F.col("d_aux").alias("d"), F.col("side_q").alias("q"))
    same = df.select(*base, *[F.col(c).alias(c + "_aux2") for c in base])
    aux2 = df.where("method = 'F'").select(*base, F.col("side_v").alias("v"))
    upcoming = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("side"), F.col("s_nationkey").cast("string").alias("opp"), F.lit("2030-01-01").cast("date").alias("d"))
    out = joins.three_source_join(df.select("contest", *base), [(aux, mapped, "_aux"), (aux2, same, "_aux2")], upcoming)
    return out.select("contest", "side", "opp", day("d").alias("d"), "is_upcoming", "side_aux", "q_aux", "v_aux2")


_J4 = """, a AS (SELECT side, opp, d, count(*) AS n FROM raw WHERE flag = 'R' GROUP BY ALL),
b AS (SELECT side AS s2, opp AS o2, d AS d2, count(*) AS n2 FROM raw WHERE flag <> 'R' GROUP BY ALL)
"""


def _two_tables(spark, sf):
    df = raw_contests(spark, sf)
    a = df.where("flag = 'R'").groupBy("side", "opp", "d").agg(F.count(F.lit(1)).alias("n"))
    b = df.where("flag <> 'R'").groupBy(F.col("side").alias("s2"), F.col("opp").alias("o2"), F.col("d").alias("d2")).agg(F.count(F.lit(1)).alias("n2"))
    return a, b


@query("J4_tolerant_date_join", raw_sql(_J4 + """SELECT side, opp, CAST(d AS VARCHAR) AS d, CAST(d2 AS VARCHAR) AS d2, n, n2
FROM a JOIN b ON side = s2 AND opp = o2 AND abs(date_diff('day', d, d2)) <= 20"""))
def j4(spark, sf):
    a, b = _two_tables(spark, sf)
    out = joins.tolerant_date_join(a, b, [("side", "s2"), ("opp", "o2")], "d", "d2", 20)
    return out.select("side", "opp", day("d").alias("d"), day("d2").alias("d2"), "n", "n2")


@query("J5_jitter_date_join", raw_sql(_J4 + """SELECT side, opp, CAST(d2 AS VARCHAR) AS d, CAST(d AS VARCHAR) AS d_orig, n, n2
FROM a JOIN b ON side = s2 AND opp = o2 AND abs(date_diff('day', d, d2)) <= 1"""))
def j5(spark, sf):
    a, b = _two_tables(spark, sf)
    out = joins.jitter_date_join(a, b.toDF("side", "opp", "d", "n2"), ["side", "opp"], "d", 1)
    return out.select("side", "opp", day("d").alias("d"), day("d_orig").alias("d_orig"), "n", "n2")


@query("J6_orientation_join", priced_sql("""SELECT dbl.contest, dbl.side, p.ml_side AS price_side, p.ml_opp AS price_opp FROM dbl
LEFT JOIN priced p ON dbl.contest = p.contest AND dbl.side = p.side AND p.flag <> 'N'"""))
def j6(spark, sf):
    quoted = priced(spark, sf).where("flag <> 'N' and side < opp")
    odds = quoted.select("side", "opp", "d", F.col("ml_side").alias("price_side"), F.col("ml_opp").alias("price_opp"))
    out = joins.orientation_join(contests(spark, sf), odds, K, {"price_side": "price_opp"})
    return out.select("contest", "side", "price_side", "price_opp")


_PROPS = """, nm AS (SELECT DISTINCT event, side AS name, '/f/' || side AS href FROM dbl),
pr AS (SELECT event, 'over ' || CAST(CAST(side_q AS INT) AS VARCHAR) AS prop, CASE WHEN method = 'F' THEN side ELSE 'Event' END AS side_name,
  CASE WHEN method = 'F' THEN opp ELSE 'Event' END AS opp_name FROM dbl)
"""


@query("J7_prop_join", dbl_sql(_PROPS + """SELECT pr.event, prop, side_name, opp_name, a.href AS side_href, b.href AS opp_href, 'contest' AS lvl FROM pr
LEFT JOIN nm a ON a.event = pr.event AND a.name = side_name LEFT JOIN nm b ON b.event = pr.event AND b.name = opp_name WHERE side_name <> 'Event'
UNION ALL SELECT event, prop, NULL, NULL, NULL, NULL, 'event' FROM pr WHERE side_name = 'Event'"""))
def j7(spark, sf):
    df = contests(spark, sf)
    names = df.select("event", F.col("side").alias("name"), F.concat(F.lit("/f/"), "side").alias("href")).distinct()
    pick = lambda c: F.when(F.col("method") == "F", F.col(c)).otherwise("Event")
    props = df.select("event", F.concat(F.lit("over "), F.col("side_q").cast("int").cast("string")).alias("prop"),
                      pick("side").alias("side_name"), pick("opp").alias("opp_name"))
    at_event, in_contest = joins.prop_join(props, names, "event")
    return union_all_by_name(in_contest.withColumn("lvl", F.lit("contest")), at_event.withColumn("lvl", F.lit("event")))


def _source_rows(spark, sf):
    """Two rows per meeting in page order, as a price page lists them."""
    df = raw_contests(spark, sf).select("event", "line", "contest", "side", "opp", "side_v", "opp_v")
    both = F.array(F.struct(F.lit(1).alias("pos"), F.col("side").alias("name"), F.col("side_v").alias("v")),
                   F.struct(F.lit(2).alias("pos"), F.col("opp").alias("name"), F.col("opp_v").alias("v")))
    return df.select("event", "line", F.explode(both).alias("x"), "contest", "side_v").select("event", "line", "contest", F.col("side_v").alias("match_v"), "x.*")


@query("J8_pair_merge_first_last", raw_sql("""SELECT DISTINCT event, line, contest, side_v AS match_v, side AS name_side, opp AS name_opp, side_v AS v_side, opp_v AS v_opp FROM raw"""))
def j8(spark, sf):
    rows = _source_rows(spark, sf).distinct()
    return joins.pair_merge_first_last(rows, ["event", "line", "contest", "match_v"], ["pos"])


@query("J9_outcome_pivot_join", raw_sql("""SELECT event, contest, least(side, opp) AS side, greatest(side, opp) AS opp,
max(CASE WHEN side < opp THEN side_v ELSE opp_v END) AS side_price, max(CASE WHEN side < opp THEN opp_v ELSE side_v END) AS opp_price
FROM raw GROUP BY ALL"""))
def j9(spark, sf):
    df = raw_contests(spark, sf)
    outcomes = F.array(F.struct(F.col("side").alias("outcome"), F.col("side_v").alias("price")), F.struct(F.col("opp").alias("outcome"), F.col("opp_v").alias("price")),
                       F.struct(F.lit("Draw").alias("outcome"), F.lit(1e9).alias("price")))
    rows = df.select("event", "contest", F.least("side", "opp").alias("a"), F.greatest("side", "opp").alias("b"), F.explode(outcomes).alias("o"))
    rows = rows.select("event", "contest", F.col("a").alias("side"), F.col("b").alias("opp"), "o.outcome", "o.price")
    return joins.outcome_pivot_join(rows, ["event", "contest", "side", "opp"], "outcome", "price")


@query("J10_open_close_join", """SELECT user_id, event_type, CAST(epoch_us(min(ts)) AS BIGINT) AS open_us, CAST(epoch_us(max(ts)) AS BIGINT) AS close_us,
arg_min(value, ts) AS open_value, arg_max(value, ts) AS close_value FROM events GROUP BY ALL""")
def j10(spark, sf):
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = joins.open_close_join(ev, ["user_id", "event_type"], "ts", ["value"])
    return out.select("user_id", "event_type", F.unix_micros("open_ts").alias("open_us"), F.unix_micros("close_ts").alias("close_us"), "open_value", "close_value")


@query("J11_semi_anti_membership", dbl_sql("""SELECT contest, side, opp FROM dbl WHERE side IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal >= 0)
AND opp NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal >= 0)"""))
def j11(spark, sf):
    known = table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").cast("string"))
    return joins.semi_anti_membership(joins.semi_anti_membership(contests(spark, sf), "side", known), "opp", known, keep=False).select("contest", "side", "opp")


@query("J12_map_column", dbl_sql("""SELECT contest, side, s_name AS side_name FROM dbl
LEFT JOIN supplier ON side = CAST(s_suppkey AS VARCHAR) AND s_acctbal > 0"""))
def j12(spark, sf):
    names = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string"), "s_name")
    return joins.map_column(contests(spark, sf), "side", names, "side_name").select("contest", "side", "side_name")


@query("J13_upcoming_enrich", """WITH m AS (SELECT CAST(c_custkey AS VARCHAR) AS c, CAST(c_nationkey AS VARCHAR) AS n FROM customer WHERE c_acctbal > 0),
b AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name, n_regionkey FROM nation),
u AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS s0, CAST(o_custkey + 1 AS VARCHAR) AS o0 FROM orders WHERE o_orderstatus = 'P'),
e AS (SELECT o_orderkey, coalesce(x.n, s0) AS side, coalesce(y.n, o0) AS opp FROM u LEFT JOIN m x ON s0 = x.c LEFT JOIN m y ON o0 = y.c)
SELECT o_orderkey, side, opp, p.n_name, p.n_regionkey, q.n_name AS n_name_opp, q.n_regionkey AS n_regionkey_opp
FROM e LEFT JOIN b p ON side = p.id LEFT JOIN b q ON opp = q.id""")
def j13(spark, sf):
    maps = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))
    bios = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), "n_name", "n_regionkey")
    future = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("side"), (F.col("o_custkey") + 1).cast("string").alias("opp"))
    return joins.upcoming_enrich(future, maps, bios)


@query("J14_close_line_join", priced_sql(f"""SELECT dbl.contest, dbl.side, c.event AS line_event, {r('c.p_side')} AS p_close FROM dbl
LEFT JOIN priced c ON dbl.contest = c.contest AND dbl.side = c.side AND dbl.opp = c.opp AND dbl.d = c.d AND dbl.event = c.event AND c.method = 'O'"""))
def j14(spark, sf):
    on = ["contest", "side", "opp", "d", "event"]
    close = priced(spark, sf).where("method = 'O'").select(*on, F.col("event").alias("line_event"), rd("p_side").alias("p_close"))
    return joins.close_line_join(contests(spark, sf).select(*on), close, on).select("contest", "side", "line_event", "p_close")


@query("J15_feature_join", priced_sql(f"SELECT contest, side, opp, res, {r('y_pred')} AS y_pred FROM priced"))
def j15(spark, sf):
    df = materialize(priced(spark, sf).select("contest", "side", "opp", "res", rd("y_pred").alias("y_pred")), "priced")
    feats = bucketed(df.select("contest", "side", "opp", "y_pred"), "contest", "features")
    rows = bucketed(df.select("contest", "side", "opp", "res"), "contest", "contests")
    return joins.feature_join(rows, feats, K, bucket="contest")


@query("J16_multi_table_inner", dbl_sql("""SELECT contest, side, opp, event, res, side_v, side_q, opp_v FROM dbl WHERE flag <> 'N' AND method = 'F'"""))
def j16(spark, sf):
    on = ["contest", "side", "opp", "event", "res"]
    df = contests(spark, sf)
    return joins.multi_table_inner([df.select(*on, "side_v"), df.where("flag <> 'N'").select(*on, "side_q"), df.where("method = 'F'").select(*on, "opp_v")], on)


def assembly(spark, sf):
    """The canon, statistics and prices under ids of their own; markets list some contests twice, the second time on a wrong day."""
    base = [K.side, K.opp, K.date]
    # Written once: every table below is made of it.
    df = materialize(contests(spark, sf).select("contest", *base, "res", "flag", "method", "side_q", "side_v"), "contests")
    ids = lambda part, suffix, shift=0: part.select(aux_id("side").alias("side" + suffix), aux_id("opp").alias("opp" + suffix), F.date_add("d", 1 + shift).alias("d" + suffix), *base)
    named = lambda part, suffix: [F.col(c + suffix).alias(c) for c in base]
    stats_rows = df.where("flag = 'R'")
    stats = ids(stats_rows, "_x").join(stats_rows.select(*base, "side_q"), base).select(*named(None, "_x"), F.col("side_q").alias("q"))
    priced_rows = df.where("method = 'F'")
    twice = priced_rows.where("flag = 'N'")
    price_map = ids(priced_rows, "_prices").unionByName(ids(twice, "_prices", 20_000))
    prices = price_map.join(df.select(*base, "side_v"), base).select(*named(None, "_prices"), F.when(F.col("d_prices") == F.date_add("d", 1), F.col("side_v")).alias("v"), F.lit("m").alias("market"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    upcoming = suppliers.select(aux_id("id").alias("side"), F.lit("a7919").alias("opp"), F.lit("2030-01-01").cast("date").alias("d")).where(F.col("side") != F.col("opp"))
    return df.select("contest", *base, "res"), stats, ids(df, "_stats"), prices, price_map, upcoming, suppliers.select(aux_id("id").alias("a"), "id")


@query("J17_assembled_table", dbl_sql(f"""
, prices AS (SELECT side, opp, d, side_v AS v, flag = 'N' AS dup FROM dbl WHERE method = 'F'
  UNION ALL SELECT side, opp, d, NULL, TRUE FROM dbl WHERE method = 'F' AND flag = 'N')
SELECT contest, dbl.side, dbl.opp, CAST(dbl.d AS VARCHAR) AS d, FALSE AS is_upcoming, CASE WHEN flag = 'R' THEN side_q END AS q_stats,
  p.v AS v_prices, coalesce(p.dup, FALSE) AS is_dup FROM dbl LEFT JOIN prices p ON dbl.side = p.side AND dbl.opp = p.opp AND dbl.d = p.d
UNION ALL SELECT '2030-01-01_' || least(CAST(s_suppkey AS VARCHAR), '1') || '_' || greatest(CAST(s_suppkey AS VARCHAR), '1'), CAST(s_suppkey AS VARCHAR), '1', '2030-01-01', TRUE, NULL, NULL, FALSE
FROM supplier WHERE s_suppkey <> 1"""))
def j17(spark, sf):
    out, _ = joins.assemble(*assembly(spark, sf), K)
    return out.select("contest", "side", "opp", day("d").alias("d"), "is_upcoming", "q_stats", "v_prices", "is_dup")


@query("J18_best_rows", dbl_sql("""
SELECT contest, side, opp, CASE WHEN flag = 'R' THEN side_q END AS q_stats, CASE WHEN method = 'F' THEN side_v END AS v_prices FROM dbl"""))
def j18(spark, sf):
    canon, stats, stats_map, prices, price_map, _, _ = assembly(spark, sf)
    out, _ = joins.assemble(canon, stats, stats_map, prices, price_map, keys=K)
    return joins.best_rows(out, K).select("contest", "side", "opp", "q_stats", "v_prices")
