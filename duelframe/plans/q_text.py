"""String and date scalars over texts derived from the tables."""

from pyspark.sql import functions as F

from ..functions import dates as D, text as X
from .registry import query, r
from .standin import contests, day, dbl_sql, raw_contests, raw_sql, rd, table


def _grouped(df, *cols):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def _text(kind):
    """(Spark SQL, DuckDB SQL) for the same text column over lineitem."""
    q, n = "CAST(CAST(l_quantity AS INT) AS {s})", "CAST(CAST(l_quantity AS INT) + l_linenumber AS {s})"
    made = {
        "of": f"CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN '--' WHEN l_linenumber = 2 THEN {q} || ' / ' ELSE {q} || ' of ' || {n} END",
        "clock": f"CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN '-' WHEN l_linenumber = 2 THEN NULL ELSE {q} || ':' || lpad(CAST(l_linenumber * 7 AS {{s}}), 2, '0') END",
        "height": f"CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'unknown' ELSE CAST(l_linenumber AS {{s}}) || ''' ' || CAST(CAST(l_quantity AS INT) % 12 AS {{s}}) || '\", ' || {q} || ' lbs' END",
        "price": f"CASE WHEN l_linenumber = 1 THEN 'EVEN' WHEN l_linenumber = 2 THEN NULL WHEN l_returnflag = 'R' THEN '-' || {q} || '▼' ELSE {q} || '▲' END",
        "dash": f"CASE WHEN l_returnflag = 'N' THEN '-' ELSE {q} || '.5' END",
        "two": f"CASE WHEN l_linenumber = 1 THEN {q} ELSE 'ann ' || {q} || '  ' || 'bob ' || {n} END",
    }[kind]
    return made.format(s="STRING"), made.format(s="VARCHAR")


def _lines(spark, sf, kind):
    made = _text(kind)[0].replace("''' '", "\"' \"") if kind == "height" else _text(kind)[0]
    return table(spark, sf, "lineitem").select(F.expr(made).alias("t"), "l_linenumber", "l_returnflag")


def _sql_lines(kind):
    return f"(SELECT {_text(kind)[1]} AS t, l_linenumber, l_returnflag FROM lineitem)"


@query("X1_parse_x_of_y", f"""SELECT t, TRY_CAST(trim(split_part(t, 'of', 1)) AS INT) AS landed,
CASE WHEN contains(t, 'of') THEN TRY_CAST(trim(split_part(t, 'of', 2)) AS INT) END AS attempted, count(*) AS n FROM {_sql_lines('of')} GROUP BY ALL""")
def x1(spark, sf):
    df = _lines(spark, sf, "of").withColumn("p", X.parse_x_of_y("t"))
    return _grouped(df.select("t", "p.landed", "p.attempted"), "t", "landed", "attempted")


@query("X2_mmss_to_seconds", f"""SELECT t, CASE WHEN contains(t, ':') THEN TRY_CAST(split_part(t, ':', 1) AS INT) * 60 + TRY_CAST(split_part(t, ':', 2) AS INT) ELSE 0 END AS secs,
CASE WHEN contains(t, ':') THEN TRY_CAST(split_part(t, ':', 1) AS INT) * 60 + TRY_CAST(split_part(t, ':', 2) AS INT) END AS secs_or_null, count(*) AS n
FROM {_sql_lines('clock')} GROUP BY ALL""")
def x2(spark, sf):
    df = _lines(spark, sf, "clock").select("t", X.mmss_to_seconds("t", 0).alias("secs"), X.mmss_to_seconds("t").alias("secs_or_null"))
    return _grouped(df, "t", "secs", "secs_or_null")


@query("X3_id_from_url", """SELECT page_id, CASE WHEN contains(url, 'http://') THEN split_part(split_part(url, 'http://', 2), '/', 1) END AS host,
CASE WHEN contains(url, '?page=') THEN split_part(url, '?page=', 2) END AS query FROM pages""")
def x3(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.id_from_url("url", "http://").alias("host"), X.id_from_url("url", "?page=", None).alias("query"))


@query("X4_dash_to_null", f"SELECT t, TRY_CAST(nullif(t, '-') AS DOUBLE) AS x, count(*) AS n FROM {_sql_lines('dash')} GROUP BY ALL")
def x4(spark, sf):
    return _grouped(_lines(spark, sf, "dash").select("t", X.dash_to_null("t").alias("x")), "t", "x")


_FEET = "TRY_CAST(nullif(regexp_extract(t, '^([^'']*)''', 1), '') AS DOUBLE) * 12 + TRY_CAST(nullif(trim(regexp_extract(t, '''(.*?)\"', 1)), '') AS DOUBLE)"


@query("X5_feet_inches", f"SELECT t, coalesce({_FEET}, 72.0) AS inches, {_FEET} AS plain, count(*) AS n FROM {_sql_lines('height')} GROUP BY ALL")
def x5(spark, sf):
    df = _lines(spark, sf, "height").withColumn("other", F.lit("6' 0\""))
    return _grouped(df.select("t", X.feet_inches("t", "other").alias("inches"), X.feet_inches("t").alias("plain")), "t", "inches", "plain")


@query("X6_weight_reach", f"""SELECT t, TRY_CAST(nullif(trim(regexp_extract(t, ',(.*?) lbs', 1)), '') AS DOUBLE) AS lbs,
CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber * 10 AS DOUBLE) END AS reach, count(*) AS n FROM {_sql_lines('height')} GROUP BY ALL""")
def x6(spark, sf):
    df = _lines(spark, sf, "height").withColumn("r", F.expr("CASE WHEN l_linenumber > 2 THEN l_linenumber * 10 || '\"' WHEN l_linenumber = 2 THEN '\"' END"))
    return _grouped(df.select("t", X.weight_lbs("t").alias("lbs"), X.reach_inches("r").alias("reach")), "t", "lbs", "reach")


@query("X7_strip_arrows", f"SELECT t, TRY_CAST(replace(replace(t, '▲', ''), '▼', '') AS DOUBLE) AS x, count(*) AS n FROM {_sql_lines('price')} GROUP BY ALL")
def x7(spark, sf):
    return _grouped(_lines(spark, sf, "price").select("t", X.strip_arrows("t").alias("x")), "t", "x")


DECISIONS = ["KO (Punches)", "TKO (Elbows)", "Submission (Rear Naked Choke)", "submission (punches)", "Submission (Slam)", "Decision - Unanimous",
             "Decision", "Split Decision", "Majority Decision", "Technical Decision", "DQ (Knee)", "No Contest", "could not continue",
             "sumission (Armbar)", "KO/TKO", "Technical Submission (Choke)", "Decision - Split", "-", None]
_LIST = ", ".join("NULL" if s is None else f"'{s}'" for s in DECISIONS)


def _decided(spark, sf):
    pick = F.expr(f"element_at(array({_LIST}), CAST((event * 7 + line) % {len(DECISIONS)} AS INT) + 1)")
    return contests(spark, sf).withColumn("t", pick)


_DECIDED = f"(SELECT *, list_extract([{_LIST}], CAST((event * 7 + line) % {len(DECISIONS)} AS INT) + 1) AS t FROM dbl)"
_T = "lower(coalesce(t, ''))"


@query("X8_classify_method", dbl_sql(f"""SELECT t, res, CASE WHEN contains({_T}, 'no contest') THEN 'nc' WHEN contains({_T}, 'dq') THEN 'dq' WHEN res = 'D' THEN 'draw'
WHEN starts_with({_T}, 'technical decision') THEN 'technical decision'
WHEN {_T} IN ('split decision', 'decision - split', 'majority decision', 'decision - majority') THEN 'decision - split'
WHEN {_T} IN ('decision - unanimous', 'unanimous decision', 'decision') THEN 'decision - unanimous'
WHEN starts_with({_T}, 'ko (') OR starts_with({_T}, 'tko') OR {_T} IN ('tko/ko', 'ko/tko', 'ko', 'submission (punches)', 'submission (slam)') THEN 'tko/ko'
WHEN contains({_T}, 'submission') OR contains({_T}, 'sumission') THEN 'submission' ELSE '' END AS outcome,
CASE WHEN contains({_T}, 'submission') OR contains({_T}, 'sumission') THEN split_part(t, '(', 2) ELSE '' END AS sub_method, count(*) AS n FROM {_DECIDED} GROUP BY ALL"""))
def x8(spark, sf):
    df = _decided(spark, sf).withColumn("m", X.classify_method("t", "res"))
    return _grouped(df.select("t", "res", "m.outcome", "m.sub_method"), "t", "res", "outcome", "sub_method")


V2_SQL = f"""CASE WHEN starts_with({_T}, 'submission') OR starts_with({_T}, 'sumission') OR starts_with({_T}, 'technical submission') THEN 'submission'
WHEN starts_with({_T}, 'tko') OR starts_with({_T}, 'ko') OR {_T} = 'could not continue' THEN 'tko_ko' WHEN contains({_T}, 'decision') THEN 'decision' ELSE 'other' END"""


@query("X9_classify_method_v2", dbl_sql(f"SELECT t, {V2_SQL} AS outcome, count(*) AS n FROM {_DECIDED} GROUP BY ALL"))
def x9(spark, sf):
    return _grouped(_decided(spark, sf).select("t", X.classify_method_v2("t").alias("outcome")), "t", "outcome")


_EVENT = "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' ' || c_custkey || ': finals' WHEN c_custkey % 4 = 1 THEN ' M-1 ' || c_mktsegment || c_nationkey || ' - night' WHEN c_custkey % 4 = 2 THEN NULL ELSE c_name END"


@query("X10_promotion_name", f"""SELECT name, CAST(contains(name, 'machine') AS INT) AS flagged, count(*) AS n FROM
(SELECT regexp_replace(trim(split_part(split_part(trim(lower(coalesce({_EVENT}, ''))), ':', 1), '- ', 1)), '[0-9]+$', '') AS name FROM customer) GROUP BY ALL""")
def x10(spark, sf):
    df = table(spark, sf, "customer").select(X.promotion_name(F.expr(_EVENT), "machine").alias("p"))
    return _grouped(df.select("p.name", F.col("p.flagged").cast("int").alias("flagged")), "name", "flagged")


@query("X11_name_pair_split", f"""SELECT t, trim(split_part(t, '  ', 1)) AS side, CASE WHEN contains(t, '  ') THEN trim(split_part(t, '  ', 2)) END AS opp, count(*) AS n
FROM {_sql_lines('two')} GROUP BY ALL""")
def x11(spark, sf):
    df = _lines(spark, sf, "two").withColumn("p", X.name_pair_split("t"))
    return _grouped(df.select("t", "p.side", "p.opp"), "t", "side", "opp")


@query("X12_contains_flag_stance", """SELECT p_name, CAST(contains(lower(trim(p_name)), 'ring') AS INT) AS has_ring,
CASE lower(trim(stance)) WHEN 'southpaw' THEN 'southpaw' WHEN 'switch' THEN 'switch' ELSE 'orthodox' END AS stance, count(*) AS n
FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN ' Southpaw' WHEN 1 THEN 'Switch ' WHEN 2 THEN NULL WHEN 3 THEN 'Open' ELSE 'orthodox' END AS stance FROM part) GROUP BY ALL""")
def x12(spark, sf):
    stance = F.expr("CASE p_size % 5 WHEN 0 THEN ' Southpaw' WHEN 1 THEN 'Switch ' WHEN 2 THEN NULL WHEN 3 THEN 'Open' ELSE 'orthodox' END")
    df = table(spark, sf, "part").select("p_name", X.contains_flag("p_name", "ring").alias("has_ring"), X.stance_clean(stance).alias("stance"))
    return _grouped(df, "p_name", "has_ring", "stance")


_FORMAT = "CASE p_size % 4 WHEN 0 THEN '3 Rnd (5-5-' || p_size || ')' WHEN 1 THEN 'Unlimited Rnd (' || p_size || ')' WHEN 2 THEN 'No Time Limit' ELSE 'Unlimited Rnd' END"


@query("X13_round_format_minutes", """SELECT p_size, CASE p_size % 4 WHEN 0 THEN 3 WHEN 2 THEN 1 ELSE 50 END AS n_rounds,
CAST(CASE p_size % 4 WHEN 0 THEN 10 + p_size WHEN 1 THEN 50 * p_size WHEN 2 THEN 999999 ELSE 750 END AS BIGINT) AS minutes, count(*) AS n FROM part GROUP BY ALL""")
def x13(spark, sf):
    arr = X.round_format_minutes(F.expr(_FORMAT))
    df = table(spark, sf, "part").select("p_size", arr.alias("a"))
    df = df.select("p_size", F.size("a").alias("n_rounds"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("minutes"))
    return _grouped(df, "p_size", "n_rounds", "minutes")


_DESC = "'Brand: ' || p_brand || '\\n' || p_name || '\\n Type: ' || p_type || '\\nSize:' || p_size"


@query("X14_key_value_text", """SELECT p_brand AS brand, p_type AS type, p_name AS second, trim(CAST(p_size AS VARCHAR)) AS size, count(*) AS n FROM part GROUP BY ALL""")
def x14(spark, sf):
    df = table(spark, sf, "part").select(F.expr(_DESC).alias("t"))
    df = df.select(X.prefixed_values("t", {"brand": "Brand:", "type": "Type:", "size": "Size:"}).alias("v"), X.key_value_text("t", {"second": 1}).alias("k"))
    return _grouped(df.select("v.brand", "v.type", "k.second", "v.size"), "brand", "type", "second", "size")


@query("X15_suffix_flag", "SELECT url, CAST(coalesce(ends_with(CASE WHEN page_id % 3 > 0 THEN url END, 'ref=x'), FALSE) AS INT) AS hit FROM pages")
def x15(spark, sf):
    url = F.when(F.col("page_id") % 3 > 0, F.col("url"))
    return table(spark, sf, "pages").select("url", X.suffix_flag(url, "ref=x").cast("int").alias("hit"))


@query("D1_parse_mixed_date", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d FROM orders""")
def d1(spark, sf):
    d = F.col("o_orderdate")
    text = (F.when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0), "not a date")
            .when(F.col("o_orderstatus") == "O", F.concat(F.date_format(d, "M/d/yyyy"), F.lit(" (33)")))
            .when(F.col("o_orderstatus") == "F", F.date_format(d, "MMM d, yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")))
    return table(spark, sf, "orders").select("o_orderkey", day(D.parse_mixed_date(text, ["yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy"])).alias("d"))


@query("D2_days_between", """SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days,
abs(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def d2(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ship, order = F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")
    return df.select("l_orderkey", "l_linenumber", D.days_between(ship, order).alias("days"), F.abs(D.days_between(order, ship)).alias("gap"))


@query("D3_hours_between", f"""SELECT event_id, {r("h")} AS hours, {r('ln(greatest(h, 1.0))')} AS log_hours FROM
(SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3600000000.0 AS h FROM events)""")
def d3(spark, sf):
    end = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return table(spark, sf, "events").select("event_id", rd(D.hours_between(end, "ts")).alias("hours"), rd(F.ln(D.hours_between(end, "ts", 1))).alias("log_hours"))


@query("D4_week_bucket", """SELECT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS monday, CAST(week(o_orderdate) AS INT) AS iso_week, count(*) AS n FROM orders GROUP BY ALL""")
def d4(spark, sf):
    df = table(spark, sf, "orders").select(day(D.week_bucket("o_orderdate")).alias("monday"), D.week_bucket("o_orderdate", True).alias("iso_week"))
    return _grouped(df, "monday", "iso_week")


@query("D5_period_key", raw_sql("SELECT CAST(d AS VARCHAR) || '_' || contest AS period, count(*) AS n FROM raw GROUP BY ALL"))
def d5(spark, sf):
    return _grouped(raw_contests(spark, sf).select(D.period_key("d", "contest").alias("period")), "period")


@query("D6_decay_weight", f"""SELECT o_orderkey, {r("exp(ln(1 - 0.01) * date_diff('day', CAST(o_orderdate AS DATE), m) / 30.5)")} AS w
FROM orders, (SELECT CAST(max(o_orderdate) AS DATE) AS m FROM orders)""")
def d6(spark, sf):
    orders = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    newest = orders.agg(F.max("d").alias("m")).scalar()
    return orders.withColumn("m", newest).select("o_orderkey", rd(D.decay_weight("d", "m", 0.01)).alias("w"))
