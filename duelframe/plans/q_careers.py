"""Career windows."""

from pyspark.sql import functions as F

from ..operators import careers as c
from ..operators.joins import attach_both_sides
from ..session import bucketed
from .registry import query, r
from .standin import K, contests, day, entity_rows, dbl_sql, raw_contests, raw_sql, rd, table

ORDER = ["d", "contest"]
W = "(PARTITION BY side ORDER BY d, contest)"
BEFORE = "(PARTITION BY side ORDER BY d, contest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _run(name, spec, sql, out=lambda x: x):
    """Register one running feature over all doubled contests."""
    @query(name, dbl_sql(f"SELECT contest, side, {sql} AS x FROM (SELECT *, CASE WHEN flag <> 'R' THEN side_q END AS q, substr(cls, 1, 1) AS k FROM dbl)"))
    def run(spark, sf):
        df = contests(spark, sf).withColumns({"q": F.expr("CASE WHEN flag <> 'R' THEN side_q END"), "k": F.substring("cls", 1, 1)})
        ran = c.with_running(df.select("contest", "side", "d", "flag", "q", "k"), "side", ORDER, {"x": spec()}, sized_by=entity_rows(spark, sf))
        return ran.select("contest", "side", out(F.col("x")).alias("x"))
    return run


_run("W1_n_prior_contests", lambda: c.n_prior_contests(), f"row_number() OVER {W} - 1")
_run("W2_running_flag_count", lambda: c.running_flag_count(F.expr("flag = 'R'")), f"CAST(sum(CAST(flag = 'R' AS INT)) OVER {W} AS BIGINT)")
_run("W3_running_count", lambda: c.running_count(), f"count(*) OVER {W}")
_run("W6_prior_total", lambda: c.prior_total("q"),
     f"CASE WHEN lag(q) OVER {W} IS NULL THEN 0.0 ELSE CAST(sum(q) OVER {BEFORE} AS DOUBLE) END", lambda x: x.cast("double"))
_run("W7_running_min", lambda: c.running_min("q"), f"CASE WHEN q IS NOT NULL THEN min(q) OVER {W} END")
_run("W7_running_max", lambda: c.running_max("q"), f"CASE WHEN q IS NOT NULL THEN max(q) OVER {W} END")
_run("W8_prev_value", lambda: c.prev_value("k"), f"lag(k) OVER {W}")
_run("W12_ffill", lambda: c.ffill("q", 0.0), f"coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY side ORDER BY d, contest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)")


@query("W4_days_since_first", dbl_sql("SELECT contest, side, date_diff('day', min(d) OVER (PARTITION BY side), d) AS days_since_first FROM dbl"))
def w4(spark, sf):
    return c.days_since_first(contests(spark, sf).select("contest", "side", "d"), "side", "d", ORDER, sized_by=entity_rows(spark, sf)).drop("d")


@query("W5_days_since_prev", dbl_sql(f"SELECT contest, side, date_diff('day', lag(d) OVER {W}, d) AS days_since_prev FROM dbl"))
def w5(spark, sf):
    return c.days_since_prev(contests(spark, sf).select("contest", "side", "d"), "side", "d", ORDER, sized_by=entity_rows(spark, sf)).drop("d")


_HIDDEN = "(SELECT * REPLACE (CASE WHEN method = 'F' AND side_q = 1 THEN NULL ELSE side END AS side, CASE WHEN method = 'F' AND opp_q = 1 THEN NULL ELSE opp END AS opp) FROM dbl)"


@query("W9_career_table", dbl_sql(f""", h AS (SELECT *, CASE WHEN cls <> '3-MEDIUM' THEN CAST(substr(cls, 1, 1) AS INT) END AS k,
  CASE WHEN flag <> 'N' THEN side_q END AS dur FROM {_HIDDEN}),
kn AS (SELECT * EXCLUDE (rn) FROM (SELECT contest, side, d, flag, dur, k, row_number() OVER (PARTITION BY contest, side ORDER BY d, flag = 'R', dur NULLS FIRST, k NULLS FIRST) AS rn FROM h WHERE side IS NOT NULL) WHERE rn = 1),
car AS (SELECT contest, side, row_number() OVER {W} - 1 AS n_career, sum(CAST(flag = 'R' AS INT)) OVER {W} AS n_flagged,
  date_diff('day', min(d) OVER (PARTITION BY side), d) AS dsf, date_diff('day', lag(d) OVER {W}, d) AS dsp,
  CASE WHEN lag(dur) OVER {W} IS NULL THEN 0.0 ELSE sum(dur) OVER {BEFORE} END AS tot,
  CASE WHEN k IS NOT NULL THEN min(k) OVER {W} END AS mi, CASE WHEN k IS NOT NULL THEN max(k) OVER {W} END AS ma, lag(k) OVER {W} AS pk FROM kn
  UNION ALL SELECT contest, NULL, 0, 0, 0, NULL, 0.0, min(k), max(k), NULL FROM h WHERE side IS NULL GROUP BY contest)
SELECT h.contest, h.side, h.opp, a.n_career, CAST(a.n_flagged AS BIGINT) AS n_flagged, a.dsf AS days_since_first, a.dsp AS days_since_prev, {r('a.tot', 2)} AS total_duration,
  a.mi AS min_cls, a.ma AS max_cls, a.pk AS prev_cls, b.n_career AS n_career_opp, b.dsp AS days_since_prev_opp
FROM h LEFT JOIN car a ON h.contest = a.contest AND h.side IS NOT DISTINCT FROM a.side LEFT JOIN car b ON h.contest = b.contest AND h.opp IS NOT DISTINCT FROM b.side"""))
def w9(spark, sf):
    df = contests(spark, sf)
    hide = lambda who: F.when(~((F.col("method") == "F") & (F.col(f"{who}_q") == 1)), F.col(who))
    df = df.withColumns({"side": hide("side"), "opp": hide("opp"), "is_r": F.col("flag") == "R",
                         "k": F.expr("CASE WHEN cls <> '3-MEDIUM' THEN int(substr(cls, 1, 1)) END"),
                         "dur": F.expr("CASE WHEN flag <> 'N' THEN side_q END")})
    df = bucketed(df.select("contest", "side", "opp", "d", "is_r", "k", "dur"), "contest", "contests")  # read by the careers and the join
    table_ = bucketed(c.career_table(df, K, flag="is_r", duration="dur", cls="k"), "contest", "careers")  # joined to both sides
    out = attach_both_sides(df.select("contest", "side", "opp"), table_, "contest", K, null_safe=True, bucket="contest")
    return out.select("contest", "side", "opp", "n_career", "n_flagged", "days_since_first", "days_since_prev",
                      rd("total_duration", 2).alias("total_duration"), "min_cls", "max_cls", "prev_cls", "n_career_opp", "days_since_prev_opp")


@query("W10_capped_recency", dbl_sql(f"SELECT contest, side, CASE WHEN x IS NOT NULL THEN least(x, 7) END AS capped FROM (SELECT *, date_diff('day', lag(d) OVER {W}, d) AS x FROM dbl)"))
def w10(spark, sf):
    df = c.days_since_prev(contests(spark, sf).select("contest", "side", "d"), "side", "d", ORDER, sized_by=entity_rows(spark, sf))
    return df.select("contest", "side", c.capped_recency("days_since_prev", 7).alias("capped"))


@query("W11_batch_counters", dbl_sql("""SELECT side AS entity, CAST(d AS VARCHAR) AS d,
count(*) OVER w AS n_before, CAST(coalesce(sum(f) OVER w, 0) AS BIGINT) AS n_flagged_before
FROM (SELECT side, d, max(CAST(flag = 'R' AS INT)) AS f FROM dbl GROUP BY ALL)
WINDOW w AS (PARTITION BY side ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def w11(spark, sf):
    return c.batch_counters(contests(spark, sf), K, F.col("flag") == "R", sized_by=entity_rows(spark, sf, "entity")).withColumn("d", day("d"))


@query("W13_team_running_count", dbl_sql("""SELECT contest, side, s_nationkey AS team,
count(*) OVER (PARTITION BY s_nationkey ORDER BY d, contest, side) AS n_team FROM dbl JOIN supplier ON side = CAST(s_suppkey AS VARCHAR)"""))
def w13(spark, sf):
    teams = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("side"), F.col("s_nationkey").alias("team"))
    df = contests(spark, sf).select("contest", "side", "d").join(teams, "side")
    return c.team_running_count(df, "team", ["d", "contest", "side"]).drop("d")


@query("W14_position_in_block", """SELECT user_id, event_id, CAST(floor((row_number() OVER w - 1) / 3) AS BIGINT) AS block, (row_number() OVER w - 1) % 3 AS place
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w14(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return c.position_in_block(ev, "user_id", ["ts", "event_id"], 3).drop("ts")


def _page_rows(spark, sf):
    """A price page per user: some event types stand for a pair of header rows, the others for child rows."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    n = F.when(F.col("event_type") == "click", F.lit(1)).when(F.col("event_type") == "view", F.lit(2))
    out = ev.withColumn("head", F.col("event_type").isin("click", "view", "error")).withColumn("n", n)
    out = out.withColumn("i", F.explode(F.when(F.col("head"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return out.select("user_id", "event_id", "ts", "i", "head",
                      F.when(F.col("head"), F.when((F.col("i") == 1) & (F.col("value") > 40), F.lit(2)).otherwise(F.col("n"))).alias("n"),
                      F.concat_ws("-", F.col("event_id").cast("string"), F.col("i").cast("string")).alias("name"))


@query("W15_segment_attribution", """WITH p AS (SELECT user_id, event_id, ts, i, head, CASE WHEN head THEN CASE WHEN i = 1 AND value > 40 THEN 2 ELSE n END END AS n,
  event_id || '-' || i AS name FROM (SELECT *, event_type IN ('click', 'view', 'error') AS head,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS n,
  unnest(CASE WHEN event_type IN ('click', 'view', 'error') THEN [0, 1] ELSE [0] END) AS i FROM events)),
q AS (SELECT *, row_number() OVER w AS rw, sum(CAST(head AS INT)) OVER w AS heads FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id, i)),
pairs AS (SELECT user_id, (heads + 1) // 2 AS block, max(CASE WHEN heads % 2 = 1 THEN name END) AS s, max(CASE WHEN heads % 2 = 0 THEN name END) AS o,
  max(CASE WHEN heads % 2 = 1 THEN coalesce(n, 0) END) AS n0, max(CASE WHEN heads % 2 = 0 THEN coalesce(n, 0) END) AS n1,
  max(CASE WHEN heads % 2 = 0 THEN rw END) AS st FROM q WHERE head GROUP BY ALL)
SELECT q.user_id, q.event_id, q.i, CAST((heads + 1) // 2 AS BIGINT) AS block,
  CASE WHEN head AND heads % 2 = 1 THEN 'side' WHEN head THEN 'opp' WHEN rw - st <= 2 * n1 THEN 'child' ELSE 'event' END AS role,
  CASE WHEN NOT head AND rw - st <= 2 * n1 THEN s END AS side_name, CASE WHEN NOT head AND rw - st <= 2 * n1 THEN o END AS opp_name,
  CAST(coalesce(NOT (head AND heads % 2 = 1) AND n0 <> n1, FALSE) AS INT) AS violation
FROM q LEFT JOIN pairs ON q.user_id = pairs.user_id AND (heads + 1) // 2 = block""")
def w15(spark, sf):
    out = c.segment_attribution(_page_rows(spark, sf), "user_id", ["ts", "event_id", "i"], "head", "n", "name")
    return out.select("user_id", "event_id", "i", "block", "role", "side_name", "opp_name", F.col("violation").cast("int").alias("violation"))


@query("W16_card_rank", raw_sql("SELECT event, contest, line, side_v, row_number() OVER (PARTITION BY event ORDER BY line, contest, side_v, opp_v) AS card_rank FROM raw"))
def w16(spark, sf):
    df = raw_contests(spark, sf).select("event", "contest", "line", "side_v", "opp_v")
    return c.card_rank(df, "event", ["line", "contest", "side_v", "opp_v"]).drop("opp_v")
