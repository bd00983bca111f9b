"""Contests derived from the given tables, in Spark and as SQL fragments.

Consecutive lines of an order meet: the supplier of a line is the side, that of the next line the opponent.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.odds import american_to_decimal, american_to_prob, devig_pair
from ..keys import Keys
from ..operators.careers import Run, with_running
from ..operators.entities import contest_key
from ..operators.joins import double_contests
from ..session import tune
from ..sources.tables import read_table

K = Keys()
PAIRS = {"side": "opp", "side_v": "opp_v", "side_q": "opp_q"}
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir, name) -> DataFrame:
    tune(spark)
    return read_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def raw_contests(spark, sf_dir) -> DataFrame:
    """One row per meeting, in the orientation of the order lines; contests may repeat."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    met = with_running(lines, "l_orderkey", order, {
        "next": Run("lead", F.struct(F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q")))},
        hot_rows=None)  # an order has few lines
    met = met.where("next.s is not null and next.s <> l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    joined = met.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    base = joined.select(
        F.col("o_orderdate").cast("date").alias("d"), F.col("l_suppkey").cast("string").alias("side"),
        F.col("next.s").cast("string").alias("opp"), F.col("l_extendedprice").alias("side_v"), F.col("next.p").alias("opp_v"),
        F.col("l_quantity").alias("side_q"), F.col("next.q").alias("opp_q"), F.col("l_orderkey").alias("event"),
        F.col("l_linenumber").alias("line"), F.col("o_orderpriority").alias("cls"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("method"))
    result = F.when(F.col("side_q") == F.col("opp_q"), "D").when(F.col("side_v") > F.col("opp_v"), "W").otherwise("L")
    return base.select(contest_key("side", "opp", "d").alias("contest"), "*", result.alias("res"))


def contests(spark, sf_dir) -> DataFrame:
    """Exactly two rows per contest."""
    return double_contests(raw_contests(spark, sf_dir), K, PAIRS, outcome="res")


def entity_rows(spark, sf_dir, name="side") -> DataFrame:
    """At least as many rows per supplier as the doubled contests have: a line meets the one before and the one after."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias(name))
    return lines.unionAll(lines)


def with_outcome(df) -> DataFrame:
    return df.withColumn("y", F.when(F.col("res") == "W", 1).when(F.col("res") == "L", 0))


def priced(spark, sf_dir) -> DataFrame:
    """Contests with American prices, implied probabilities, decimal odds and a model probability."""
    df = with_outcome(contests(spark, sf_dir))
    favourite = (F.col("side_q") > F.col("opp_q")) | ((F.col("side_q") == F.col("opp_q")) & (F.col("side") < F.col("opp")))
    price = lambda fav, q: F.when(fav, -(110 + 3 * F.col(q))).otherwise(100 + 2 * F.col(q))
    out = df.withColumns({"ml_side": price(favourite, "side_q"), "ml_opp": price(~favourite, "opp_q")})
    fair = devig_pair(american_to_prob("ml_side"), american_to_prob("ml_opp"))
    edge = (F.col("side_q") - F.col("opp_q")) / 25 + (F.col("side_v") - F.col("opp_v")) / 200000
    return out.withColumns({
        "p_side": fair["side"], "p_opp": fair["opp"],
        "side_odds": american_to_decimal("ml_side"), "opp_odds": american_to_decimal("ml_opp"),
        "y_pred": 1 / (1 + F.exp(-edge))})


# -- the same as SQL ------------------------------------------------------------------------------

RAW = """l AS (SELECT *, lead(l_suppkey) OVER w AS o_s, lead(l_extendedprice) OVER w AS o_p, lead(l_quantity) OVER w AS o_q
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
raw0 AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(l_suppkey AS VARCHAR) AS side, CAST(o_s AS VARCHAR) AS opp,
  l_extendedprice AS side_v, o_p AS opp_v, l_quantity AS side_q, o_q AS opp_q, l_orderkey AS event, l_linenumber AS line,
  o_orderpriority AS cls, l_returnflag AS flag, l_linestatus AS method
  FROM l JOIN orders ON l_orderkey = o_orderkey WHERE o_s IS NOT NULL AND o_s <> l_suppkey),
raw AS MATERIALIZED (SELECT strftime(d, '%Y-%m-%d') || '_' || least(side, opp) || '_' || greatest(side, opp) AS contest, *,
  CASE WHEN side_q = opp_q THEN 'D' WHEN side_v > opp_v THEN 'W' ELSE 'L' END AS res FROM raw0)"""

DBL = RAW + """,
one AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY contest
  ORDER BY side, opp, d, side_v, opp_v, side_q, opp_q, event, line, cls, flag, method, res) AS rn FROM raw) WHERE rn = 1),
dbl AS MATERIALIZED (SELECT * FROM one UNION ALL
  SELECT contest, d, opp, side, opp_v, side_v, opp_q, side_q, event, line, cls, flag, method,
    CASE res WHEN 'W' THEN 'L' WHEN 'L' THEN 'W' ELSE res END FROM one)"""

PRICED = DBL + """,
pr0 AS (SELECT *, CASE res WHEN 'W' THEN 1 WHEN 'L' THEN 0 END AS y,
  (side_q > opp_q OR (side_q = opp_q AND side < opp)) AS fav FROM dbl),
pr1 AS (SELECT *, CASE WHEN fav THEN -(110 + 3 * side_q) ELSE 100 + 2 * side_q END AS ml_side,
  CASE WHEN NOT fav THEN -(110 + 3 * opp_q) ELSE 100 + 2 * opp_q END AS ml_opp FROM pr0),
pr2 AS (SELECT *, CASE WHEN ml_side <= 0 THEN -ml_side / (100 - ml_side) ELSE 100 / (100 + ml_side) END AS i_side,
  CASE WHEN ml_opp <= 0 THEN -ml_opp / (100 - ml_opp) ELSE 100 / (100 + ml_opp) END AS i_opp FROM pr1),
priced AS MATERIALIZED (SELECT * EXCLUDE (fav, i_side, i_opp), i_side / (i_side + i_opp) AS p_side, i_opp / (i_side + i_opp) AS p_opp,
  CASE WHEN ml_side < 0 THEN -100 / ml_side + 1 ELSE ml_side / 100 + 1 END AS side_odds,
  CASE WHEN ml_opp < 0 THEN -100 / ml_opp + 1 ELSE ml_opp / 100 + 1 END AS opp_odds,
  1 / (1 + exp(-((side_q - opp_q) / 25 + (side_v - opp_v) / 200000))) AS y_pred FROM pr2)"""


def raw_sql(body):
    return f"WITH {RAW}\n{body}"


def dbl_sql(body):
    return f"WITH {DBL}\n{body}"


def priced_sql(body):
    return f"WITH {PRICED}\n{body}"


def day(c):
    """Spark: dates leave as text so that both engines print them alike."""
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def rd(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)
