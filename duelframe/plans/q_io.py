"""Sources and sinks."""

from pyspark.sql import functions as F

from ..operators.rows import date_query
from ..sources import tables as io
from .registry import query, r
from .standin import SCHEMAS, contests, dbl_sql, day, rd, table

STATUSES = ("O", "F", "P")


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_orderstatus", "o_totalprice")


_RANK = "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END"
_OUT = "o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey, o_orderstatus, o_totalprice"


@query("IO1_read_table", f"""SELECT l_returnflag, count(*) AS n, {r('sum(l_quantity)', 2)} AS quantity
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY l_returnflag""")
def io1(spark, sf):
    df = date_query(io.read_table(spark, f"{sf}/lineitem.parquet", SCHEMAS["lineitem"]), "l_shipdate", start="1995-01-01")
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("l_quantity"), 2).alias("quantity"))


@query("IO2_write_replace", dbl_sql("SELECT contest, side, opp, side_v, res FROM dbl"))
def io2(spark, sf):
    path = io.scratch_table(spark, "io2")
    df = contests(spark, sf).select("contest", "side", "opp", "side_v", "res")
    io.write_replace(table(spark, sf, "nation"), path)
    io.write_replace(df, path)
    return io.read_table(spark, path, df.schema)


@query("IO3_upsert", f"""SELECT {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)
ORDER BY {_RANK} DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def io3(spark, sf):
    path, df = io.scratch_table(spark, "io3"), _orders(spark, sf)
    for status in STATUSES:
        io.upsert(df.where(F.col("o_orderstatus") == status), path, ["o_custkey", "day"], ["o_orderkey"])
    return io.read_table(spark, path).withColumn("day", day("day"))


@query("IO4_insert_ignore", f"""SELECT {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)
ORDER BY {_RANK}, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def io4(spark, sf):
    path, df = io.scratch_table(spark, "io4"), _orders(spark, sf)
    for status in STATUSES:
        io.insert_ignore(df.where(F.col("o_orderstatus") == status), path, ["o_custkey", "day"])
    return io.read_table(spark, path, df.schema).withColumn("day", day("day"))


@query("IO5_insert_or_replace", f"""SELECT {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
ORDER BY {_RANK} DESC, CAST(o_orderdate AS DATE), o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def io5(spark, sf):
    path, df = io.scratch_table(spark, "io5"), _orders(spark, sf)
    for status in STATUSES:
        io.insert_or_replace(df.where(F.col("o_orderstatus") == status), path, ["o_custkey"])
    return io.read_table(spark, path).withColumn("day", day("day"))


@query("IO6_append_stamped", """SELECT event_type, 2 * count(*) AS n, 2 * count(*) AS n_stamped FROM events GROUP BY event_type""")
def io6(spark, sf):
    path, df = io.scratch_table(spark, "io6"), table(spark, sf, "events").select("event_id", "event_type", "value")
    for _ in range(2):
        io.append_stamped(df, path, "ingested")
    back = io.read_table(spark, path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("ingested").alias("n_stamped"))


@query("IO7_read_csv_typed", f"""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n,
{r('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1""")
def io7(spark, sf):
    path, df = io.scratch_table(spark, "io7"), _orders(spark, sf)
    io.write_csv(df, path)
    back = io.read_csv_typed(spark, path, df.schema)
    return back.groupBy(day("day").alias("day")).agg(F.count(F.lit(1)).alias("n"), rd(F.sum("o_totalprice"), 2).alias("total"))


@query("IO8_write_csv", "SELECT s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def io8(spark, sf):
    path = io.scratch_table(spark, "io8")
    io.write_csv(table(spark, sf, "supplier").select("s_name", "s_nationkey"), path)
    return spark.read.schema("s_name string, s_nationkey string").option("header", True).csv(path)


@query("IO9_partitioned_by_initial", """SELECT upper(substring(c_mktsegment, 1, 1)) AS initial, count(*) AS n,
count(DISTINCT c_mktsegment) AS n_keys FROM customer GROUP BY 1""")
def io9(spark, sf):
    path = io.scratch_table(spark, "io9")
    io.partitioned_by_initial(table(spark, sf, "customer"), path, "c_mktsegment")
    return spark.read.parquet(path).groupBy("initial").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("n_keys"))
