"""Prices, probabilities and numeric features."""

from pyspark.sql import functions as F

from ..functions import odds as M, text as X
from .q_text import _DECIDED, _decided, V2_SQL
from .registry import query, r
from .standin import contests, dbl_sql, priced, priced_sql, rd, table, with_outcome

# American prices with missing and zero values.
_ML = "(SELECT *, CASE WHEN flag = 'N' AND line = 1 THEN NULL WHEN flag = 'A' AND line = 1 THEN 0.0 ELSE ml_side END AS ml FROM priced)"


def _prices(spark, sf):
    return priced(spark, sf).withColumn("ml", F.expr("CASE WHEN flag = 'N' AND line = 1 THEN NULL WHEN flag = 'A' AND line = 1 THEN 0.0D ELSE ml_side END"))


_PROB = "CASE WHEN {0} <= 0 THEN -{0} / (100 - {0}) WHEN {0} > 0 THEN 100 / (100 + {0}) END"
_PAY = "CASE WHEN {0} < 0 THEN -100 / {0} WHEN {0} > 0 THEN {0} / 100 END"
_LOGIT = "ln({0} / (1 - {0}))"


@query("M1_american_to_prob", priced_sql(f"SELECT contest, side, ml, {r(_PROB.format('ml'))} AS p FROM {_ML}"))
def m1(spark, sf):
    return _prices(spark, sf).select("contest", "side", "ml", rd(M.american_to_prob("ml")).alias("p"))


@query("M2_american_to_decimal", priced_sql(f"SELECT contest, side, {r('1 + ' + _PAY.format('ml'))} AS dec, {r(_PAY.format('ml'))} AS payout FROM {_ML}"))
def m2(spark, sf):
    return _prices(spark, sf).select("contest", "side", rd(M.american_to_decimal("ml")).alias("dec"), rd(M.american_to_payout("ml")).alias("payout"))


@query("M3_decimal_to_prob", priced_sql(f"""SELECT contest, side, {r('1 / side_odds')} AS p,
{r('CASE WHEN side_odds >= 2 THEN (side_odds - 1) * 100 WHEN side_odds > 1 THEN -100 / (side_odds - 1) END', 4)} AS american FROM priced"""))
def m3(spark, sf):
    return priced(spark, sf).select("contest", "side", rd(M.decimal_to_prob("side_odds")).alias("p"), rd(M.decimal_to_american("side_odds"), 4).alias("american"))


@query("M4_devig_pair", priced_sql(f"SELECT contest, side, {r('a / (a + b)')} AS p_side, {r('b / (a + b)')} AS p_opp, {r('1')} AS total FROM (SELECT *, {_PROB.format('ml_side')} AS a, {_PROB.format('ml_opp')} AS b FROM priced)"))
def m4(spark, sf):
    df = priced(spark, sf).withColumn("f", M.devig_pair(M.american_to_prob("ml_side"), M.american_to_prob("ml_opp")))
    return df.select("contest", "side", rd("f.side").alias("p_side"), rd("f.opp").alias("p_opp"), rd(F.col("f.side") + F.col("f.opp")).alias("total"))


@query("M5_worst_close", priced_sql(f"""SELECT contest, side, {r(f"CASE WHEN ml IS NOT NULL AND ml_opp IS NOT NULL THEN least({_PROB.format('ml')}, {_PROB.format('ml_opp')}) END")} AS p FROM {_ML}"""))
def m5(spark, sf):
    return _prices(spark, sf).select("contest", "side", rd(M.worst_close("ml", "ml_opp")).alias("p"))


@query("M6_logit_expit", priced_sql(f"SELECT contest, side, {r(_LOGIT.format('p_side'))} AS lo, {r('1 / (1 + exp(-(side_q / 10)))')} AS ex FROM priced"))
def m6(spark, sf):
    return priced(spark, sf).select("contest", "side", rd(M.logit("p_side")).alias("lo"), rd(M.expit(F.col("side_q") / 10)).alias("ex"))


@query("M7_line_movement", priced_sql(f"SELECT contest, side, {r(_LOGIT.format('y_pred') + ' - ' + _LOGIT.format('p_side'))} AS moved FROM priced"))
def m7(spark, sf):
    return priced(spark, sf).select("contest", "side", rd(M.line_movement("y_pred", "p_side")).alias("moved"))


@query("M8_best_price", priced_sql(f"""SELECT contest, side, greatest(ml, ml_opp) AS best,
{r("(coalesce(" + _PROB.format('ml') + ", 0) + " + _PROB.format('ml_opp') + ") / (1 + CAST(ml IS NOT NULL AS INT))")} AS consensus FROM {_ML}"""))
def m8(spark, sf):
    return _prices(spark, sf).select("contest", "side", M.best_price(["ml", "ml_opp"]).alias("best"),
                                     rd(M.consensus_prob([M.american_to_prob("ml"), M.american_to_prob("ml_opp")])).alias("consensus"))


@query("M9_clip_adjustment", priced_sql(f"""SELECT contest, side, {r(f"1 / (1 + exp(-({_LOGIT.format('p_side')} + least(0.2, greatest(-0.2, {_LOGIT.format('y_pred')} - {_LOGIT.format('p_side')})))))")} AS p FROM priced"""))
def m9(spark, sf):
    return priced(spark, sf).select("contest", "side", rd(M.clip_adjustment("y_pred", "p_side")).alias("p"))


@query("M10_diffs", dbl_sql(f"""SELECT contest, side, {r('sqrt(side_v) - sqrt(opp_v)')} AS sq, {r('ln(greatest(side_q, 5)) - ln(greatest(opp_q, 5))')} AS lg,
{r('ln(side_q + 1) - ln(opp_q + 1)')} AS lg1, {r("coalesce(CASE WHEN flag <> 'R' THEN side_q END - opp_q, 0)")} AS df FROM dbl"""))
def m10(spark, sf):
    df = contests(spark, sf).withColumn("q", F.expr("CASE WHEN flag <> 'R' THEN side_q END"))
    return df.select("contest", "side", rd(M.sqrt_diff("side_v", "opp_v")).alias("sq"), rd(M.log_diff("side_q", "opp_q", floor=5)).alias("lg"),
                     rd(M.log_diff("side_q", "opp_q", add=1.0)).alias("lg1"), rd(M.diff("q", "opp_q", fill=0)).alias("df"))


_SUBS = "CAST(o = 'submission' AND res = 'W' AS INT)"


@query("M11_attempt_fail", dbl_sql(f"""SELECT contest, side, CASE WHEN q IS NOT NULL THEN greatest(0, q - opp_q) END AS fail, {_SUBS} AS sub_landed,
CASE WHEN q IS NOT NULL THEN greatest(q, {_SUBS}) END AS sub_attempted, CASE WHEN q IS NOT NULL THEN greatest(0, q - {_SUBS}) END AS sub_fail
FROM (SELECT *, CASE WHEN flag <> 'R' THEN side_q END AS q, {V2_SQL} AS o FROM {_DECIDED})"""))
def m11(spark, sf):
    df = _decided(spark, sf).withColumns({"q": F.expr("CASE WHEN flag <> 'R' THEN side_q END"), "o": X.classify_method_v2("t")})
    df = df.withColumn("s", M.submission_counts("q", "o", "res"))
    return df.select("contest", "side", M.attempt_fail("q", "opp_q").alias("fail"), F.col("s.landed").alias("sub_landed"),
                     F.col("s.attempted").alias("sub_attempted"), F.col("s.fail").alias("sub_fail"))


@query("M12_body_ratios", f"SELECT p_partkey, {r('p_size / (p_retailprice / 15)')} AS ape_index, {r('p_size / ((p_retailprice / 15) * (p_retailprice / 15)) * 703')} AS bmi FROM part")
def m12(spark, sf):
    height = F.col("p_retailprice") / 15
    df = table(spark, sf, "part").select("p_partkey", M.body_ratios("p_size", height, "p_size").alias("b"))
    return df.select("p_partkey", rd("b.ape_index").alias("ape_index"), rd("b.bmi").alias("bmi"))


_STANCE = "CASE CAST({} AS INT) % 3 WHEN 0 THEN 'southpaw' WHEN 1 THEN 'orthodox' ELSE 'switch' END"


@query("M13_stance_advantage", dbl_sql(f"""SELECT a, b, CASE WHEN a <> 'orthodox' AND b = 'orthodox' THEN 1 WHEN a = 'orthodox' AND b <> 'orthodox' THEN -1 ELSE 0 END AS adv, count(*) AS n
FROM (SELECT {_STANCE.format('side_q')} AS a, {_STANCE.format('opp_q')} AS b FROM dbl) GROUP BY ALL"""))
def m13(spark, sf):
    df = contests(spark, sf).select(F.expr(_STANCE.format("side_q")).alias("a"), F.expr(_STANCE.format("opp_q")).alias("b"))
    return df.select("a", "b", M.stance_advantage("a", "b").alias("adv")).groupBy("a", "b", "adv").agg(F.count(F.lit(1)).alias("n"))


_SIGN = "CASE res WHEN 'W' THEN -1.0 WHEN 'L' THEN 1.0 END"
_CLIPPED = "least(greatest(side_q * 40, 60), 1500)"


@query("M14_signed_inverse_time", dbl_sql(f"""SELECT contest, side, {r(f'{_SIGN} / {_CLIPPED}', 9)} AS inv, {r(f'{_SIGN} / sqrt({_CLIPPED})')} AS inv_sqrt,
{r(f'{_SIGN} / ln({_CLIPPED})')} AS inv_log FROM dbl"""))
def m14(spark, sf):
    df = with_outcome(contests(spark, sf)).withColumn("t", F.col("side_q") * 40)
    return df.select("contest", "side", rd(M.signed_inverse_time("y", "t"), 9).alias("inv"), rd(M.signed_inverse_time("y", "t", "sqrt")).alias("inv_sqrt"),
                     rd(M.signed_inverse_time("y", "t", "log")).alias("inv_log"))


@query("M15_contest_duration", dbl_sql("""SELECT contest, side, CASE WHEN flag = 'N' THEN (CASE WHEN s IS NULL THEN line * 300 ELSE (line - 1) * 300 + s END)
WHEN s IS NULL THEN line * 300 ELSE (CASE WHEN line > 3 THEN 5 + 5 + 3 ELSE [0, 5, 10][line] END) * 60 + s END AS secs FROM (SELECT *, CASE WHEN side_q > 2 THEN CAST(side_q AS INT) END AS s FROM dbl)"""))
def m15(spark, sf):
    df = contests(spark, sf).withColumns({"arr": F.expr("CASE WHEN flag <> 'N' THEN array(5, 5, 3) END"), "s": F.expr("CASE WHEN side_q > 2 THEN CAST(side_q AS INT) END")})
    return df.select("contest", "side", M.contest_duration("arr", "line", "s").alias("secs"))


@query("M16_outcome_targets", dbl_sql(f"""SELECT t, res, CASE res WHEN 'W' THEN 1 WHEN 'L' THEN 0 END AS win, CASE WHEN o IN ('submission', 'tko_ko') THEN CASE res WHEN 'W' THEN 1 WHEN 'L' THEN 0 END END AS win_finish,
s * CASE WHEN o IN ('submission', 'tko_ko') THEN 2 WHEN o = 'decision' THEN 1 ELSE 0 END AS ordinal, s * CAST(o = 'submission' AS INT) AS submission, s * CAST(o = 'tko_ko' AS INT) AS tko_ko,
s * CAST(o = 'decision' AS INT) AS decision, s * CAST(o IN ('submission', 'tko_ko') AS INT) AS finish, count(*) AS n
FROM (SELECT t, res, {V2_SQL} AS o, CASE res WHEN 'W' THEN 1 WHEN 'L' THEN -1 WHEN 'D' THEN 0 END AS s FROM {_DECIDED}) GROUP BY ALL"""))
def m16(spark, sf):
    df = _decided(spark, sf).withColumn("g", M.outcome_targets("res", X.classify_method_v2("t"))).select("t", "res", "g.*")
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))


@query("M17_volume_index", dbl_sql(f"""SELECT contest, side, side_q + 10 * line AS volume, {r('coalesce((side_q - opp_q) / (line * 300), 0)')} AS share FROM dbl"""))
def m17(spark, sf):
    return contests(spark, sf).select("contest", "side", M.volume_index("side_q", "line").alias("volume"),
                                      rd(M.share_of_duration("side_q", "opp_q", F.col("line") * 300)).alias("share"))


@query("M18_accuracy_hat", dbl_sql(f"""SELECT contest, side, {r("least(1.0, coalesce(CASE WHEN flag <> 'R' THEN side_q END, 0) / greatest(coalesce(CASE WHEN method = 'F' THEN opp_q END, 0), 1))")} AS acc FROM dbl"""))
def m18(spark, sf):
    df = contests(spark, sf)
    return df.select("contest", "side", rd(M.accuracy_hat(F.expr("CASE WHEN flag <> 'R' THEN side_q END"), F.expr("CASE WHEN method = 'F' THEN opp_q END"))).alias("acc"))
