"""Folds, metrics, bets and the two remaining extension points."""

from pyspark.sql import functions as F

from ..operators import bets as B, models as M, validate as V
from ..operators.protocols import metric_columns, model_protocol
from ..session import materialize
from .q_models import FEATS, modelled
from .registry import query, r
from .standin import day, priced, priced_sql, rd

_FOLDS = """dts AS (SELECT DISTINCT d FROM priced WHERE d >= DATE '1997-01-01'),
fd AS (SELECT d, CAST(floor((row_number() OVER (ORDER BY d) - 1) / (SELECT count(*) // 6 FROM dts)) AS INT) AS fold FROM dts),
pf AS (SELECT priced.*, fold FROM priced LEFT JOIN fd ON priced.d = fd.d)
"""
_CLIP = "least(greatest({0}, 1e-15), 1 - 1e-15)"


def _ll(p):
    q = _CLIP.format(p)
    return f"avg(-(y * ln({q}) + (1 - y) * ln(1 - {q})))"


def _acc(p):
    return f"avg(CASE WHEN y IS NOT NULL THEN CAST(({p} > 0.5 AND y = 1) OR ({p} <= 0.5 AND y = 0) AS INT) END)"


def folded(spark, sf):
    return V.time_folds(priced(spark, sf), "d", 4, None, "1997-01-01")


@query("V1_time_folds", priced_sql(", " + _FOLDS + "SELECT contest, side, CAST(d AS VARCHAR) AS d, fold FROM pf"))
def v1(spark, sf):
    return folded(spark, sf).select("contest", "side", day("d").alias("d"), "fold")


_MEAN_MODEL = """, starts AS (SELECT fold, min(d) AS start FROM pf WHERE fold IS NOT NULL GROUP BY fold),
fit AS (SELECT fold, avg(y) AS rate FROM starts JOIN (SELECT d, CASE WHEN side_q > opp_q THEN y END AS y FROM pf) ON d < start GROUP BY fold),
mp AS (SELECT contest, side, opp, d, pf.fold, y, CASE WHEN side_q > opp_q THEN rate WHEN side_q < opp_q THEN 1 - rate ELSE 0.5 END AS y_pred,
  row_number() OVER (PARTITION BY contest ORDER BY d, side) AS rn FROM pf JOIN fit ON pf.fold = fit.fold)
"""


def mean_model(train, test):
    """Win rate of the side with more quantity: a model with one number."""
    rate = train.where("side_q > opp_q").agg(F.avg("y").alias("rate")).scalar()
    out = test.withColumn("_rate", rate)
    p = F.when(F.col("side_q") > F.col("opp_q"), F.col("_rate")).when(F.col("side_q") < F.col("opp_q"), 1 - F.col("_rate")).otherwise(0.5)
    return out.withColumn("y_pred", p).drop("_rate")


@query("V2_walk_forward", priced_sql(", " + _FOLDS + _MEAN_MODEL + f"SELECT contest, side, opp, fold, {r('y_pred')} AS y_pred FROM mp WHERE rn = 1"))
def v2(spark, sf):
    df = priced(spark, sf).select("contest", "d", "side", "opp", "side_q", "opp_q", "y")
    out = V.walk_forward(model_protocol(mean_model), df, "d", "contest", 4, None, "1997-01-01")
    return out.select("contest", "side", "opp", "fold", rd("y_pred").alias("y_pred"))


_PF = f"{r(_acc('y_pred'))} AS accuracy, {r(_ll('y_pred'))} AS log_loss, {r(_acc('p_side'))} AS market_accuracy, {r(_ll('p_side'))} AS market_log_loss"
_FLAT = """CASE WHEN sum(CAST(y_pred > p_side AS INT) + CAST(1 - y_pred > p_opp AS INT)) = 0 THEN 0 ELSE
sum(CASE WHEN y_pred > p_side AND y = 1 THEN 1 / p_side - 1 WHEN y_pred > p_side AND y = 0 THEN -1 ELSE 0 END +
    CASE WHEN 1 - y_pred > p_opp AND y = 0 THEN 1 / p_opp - 1 WHEN 1 - y_pred > p_opp AND y = 1 THEN -1 ELSE 0 END) /
sum(CAST(y_pred > p_side AS INT) + CAST(1 - y_pred > p_opp AS INT)) END"""


@query("V3_fold_metrics", priced_sql(", " + _FOLDS + f"""SELECT fold, CAST(min(d) AS VARCHAR) AS min_date, CAST(max(d) AS VARCHAR) AS max_date, count(DISTINCT d) AS n_days,
count(*) AS n_rows, {_PF}, {r(_FLAT)} AS flat FROM pf WHERE fold IS NOT NULL GROUP BY fold"""))
def v3(spark, sf):
    out = V.fold_metrics(folded(spark, sf), {"flat": V.flat_return_of("y_pred", "p_side", "p_opp", "y")})
    names = ["accuracy", "log_loss", "market_accuracy", "market_log_loss", "flat"]
    return out.select("fold", day("min_date").alias("min_date"), day("max_date").alias("max_date"), "n_days", "n_rows", *[rd(c).alias(c) for c in names])


@query("V4_flat_stake_return", priced_sql(f"SELECT cls, {r(_FLAT)} AS flat_return FROM priced GROUP BY cls"))
def v4(spark, sf):
    return V.flat_stake_return(priced(spark, sf), by=["cls"]).withColumn("flat_return", rd("flat_return"))


_KS, _KO = "greatest(0, y_pred + (y_pred - 1) / (1 / p_side - 1))", "greatest(0, (1 - y_pred) - y_pred / (1 / p_opp - 1))"


@query("V5_kelly_growth", priced_sql(f"""SELECT CAST(d AS VARCHAR) AS d, {r('product(t)', 5)} AS kelly_growth FROM (SELECT d, 1 + CASE y WHEN 1 THEN {_KS} * (1 / p_side - 1) - {_KO}
WHEN 0 THEN {_KO} * (1 / p_opp - 1) - {_KS} ELSE 0 END AS t FROM priced) GROUP BY d"""))
def v5(spark, sf):
    return V.kelly_growth(priced(spark, sf), by=["d"]).select(day("d").alias("d"), rd("kelly_growth", 5).alias("kelly_growth"))


def _score(p):
    return f"y * ln({_CLIP.format(p)}) + (1 - y) * ln(1 - {_CLIP.format(p)})"


@query("V6_paired_score_z", priced_sql(f"""SELECT {r('avg(s)')} AS mean_diff, {r('avg(s) / (stddev_pop(s) / sqrt(count(s)))', 4)} AS z
FROM (SELECT ({_score('y_pred')}) - ({_score('p_side')}) AS s FROM priced)"""))
def v6(spark, sf):
    return V.paired_score_z(priced(spark, sf)).select(rd("mean_diff").alias("mean_diff"), rd("z", 4).alias("z"))


@query("V7_loss_by_group", priced_sql(f"SELECT line, {r(_ll('y_pred'))} AS log_loss, count(*) AS n FROM priced GROUP BY line"))
def v7(spark, sf):
    return V.loss_by_group(priced(spark, sf), by="line").withColumn("log_loss", rd("log_loss"))


@query("V8_accuracy_log_loss", priced_sql(f"SELECT {r(_acc('y_pred'))} AS accuracy, {r(_ll('y_pred'))} AS log_loss, count(*) AS n FROM priced WHERE y IS NOT NULL"))
def v8(spark, sf):
    return V.accuracy_log_loss(priced(spark, sf)).select(rd("accuracy").alias("accuracy"), rd("log_loss").alias("log_loss"), "n")


# -- bets -------------------------------------------------------------------------------------------

# Some contests lack both prices, some only one.
_MISSING = {"side_odds": "CASE WHEN line <> 7 AND flag <> 'N' THEN side_odds END", "opp_odds": "CASE WHEN line <> 6 AND flag <> 'N' THEN opp_odds END"}
_BETS = f"""kb AS (SELECT * FROM (SELECT * REPLACE ({_MISSING['side_odds']} AS side_odds, {_MISSING['opp_odds']} AS opp_odds) FROM priced) WHERE side_odds IS NOT NULL AND opp_odds IS NOT NULL),
kf AS (SELECT *, coalesce(greatest(0, y_pred - (1 - y_pred) / (side_odds - 1)), 0) AS kelly_side, coalesce(greatest(0, (1 - y_pred) - y_pred / (opp_odds - 1)), 0) AS kelly_opp FROM kb),
ks AS (SELECT *, sum(CAST(kelly_side > 0 AS INT) + CAST(kelly_opp > 0 AS INT)) OVER (PARTITION BY d) AS n_bets FROM kf),
stk AS (SELECT *, CASE WHEN n_bets > 0 THEN least(0.1, kelly_side / n_bets) ELSE 0 END AS stake_side, CASE WHEN n_bets > 0 THEN least(0.1, kelly_opp / n_bets) ELSE 0 END AS stake_opp FROM ks),
sett AS (SELECT *, coalesce(side_odds * stake_side * y - stake_side, 0) AS profit_side, coalesce(opp_odds * stake_opp * (1 - y) - stake_opp, 0) AS profit_opp FROM stk),
ret AS (SELECT d, sum(profit_side + profit_opp) AS ret, sum(stake_side + stake_opp) AS staked, count(*) AS n FROM sett GROUP BY d),
eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY d)) AS portfolio FROM ret)
"""


def _kelly(spark, sf):
    df = priced(spark, sf).withColumns({c: F.expr(e) for c, e in _MISSING.items()})
    return B.with_kelly(df)


def _staked(spark, sf):
    kept = _kelly(spark, sf).select("contest", "side", "d", "y", "side_odds", "opp_odds", "kelly_side", "kelly_opp")
    return B.period_stakes(kept, "d", 0.1)


def _settled(spark, sf):
    return B.settle_bets(_staked(spark, sf))


@query("B1_kelly_fraction", priced_sql(", " + _BETS + f"SELECT contest, side, {r('kelly_side')} AS kelly_side, {r('kelly_opp')} AS kelly_opp FROM kf"))
def b1(spark, sf):
    return _kelly(spark, sf).select("contest", "side", rd("kelly_side").alias("kelly_side"), rd("kelly_opp").alias("kelly_opp"))


@query("B2_period_stakes", priced_sql(", " + _BETS + f"""SELECT contest, side, CAST(n_bets AS BIGINT) AS n_bets, {r('stake_side', 8)} AS stake_side, {r('stake_opp', 8)} AS stake_opp,
CAST(kelly_side > 0 AND kelly_opp > 0 AS INT) AS both_sides, CAST(sum(stake_side + stake_opp) OVER (PARTITION BY d) >= 1 AS INT) AS over_bankroll FROM stk"""))
def b2(spark, sf):
    out = _staked(spark, sf)
    return out.select("contest", "side", "n_bets", rd("stake_side", 8).alias("stake_side"), rd("stake_opp", 8).alias("stake_opp"),
                      F.col("both_sides").cast("int").alias("both_sides"), F.col("over_bankroll").cast("int").alias("over_bankroll"))


@query("B3_settle_bets", priced_sql(", " + _BETS + f"SELECT contest, side, {r('profit_side', 8)} AS profit_side, {r('profit_opp', 8)} AS profit_opp FROM sett"))
def b3(spark, sf):
    return _settled(spark, sf).select("contest", "side", rd("profit_side", 8).alias("profit_side"), rd("profit_opp", 8).alias("profit_opp"))


def _returns(spark, sf):
    """Written, as the curve reads this small table more than once."""
    return materialize(B.period_returns(_settled(spark, sf), "d"), "returns")


@query("B4_period_returns", priced_sql(", " + _BETS + f"SELECT CAST(d AS VARCHAR) AS d, {r('ret', 8)} AS ret, {r('staked', 8)} AS staked, n FROM ret"))
def b4(spark, sf):
    return _returns(spark, sf).select(day("d").alias("d"), rd("ret", 8).alias("ret"), rd("staked", 8).alias("staked"), "n")


@query("B5_equity_curve", priced_sql(", " + _BETS + f"SELECT CAST(d AS VARCHAR) AS d, {r('ln(portfolio)', 5)} AS log_portfolio FROM eq"))
def b5(spark, sf):
    return B.equity_curve(_returns(spark, sf), "d").select(day("d").alias("d"), rd(F.ln("portfolio"), 5).alias("log_portfolio"))


@query("B6_growth_stats", priced_sql(", " + _BETS + f"""SELECT {r('exp(avg(x)) - 1')} AS geometric_growth, {r('stddev_samp(x)')} AS log_return_sd,
{r('avg(x) / (stddev_samp(x) / sqrt(count(x)))', 4)} AS t_stat, count(x) AS n, (SELECT {r('avg(ret) / (stddev_samp(ret) / sqrt(count(ret)))', 4)} FROM ret) AS sharpe
FROM (SELECT ln(portfolio) - lag(ln(portfolio)) OVER (ORDER BY d) AS x FROM eq)"""))
def b6(spark, sf):
    returns = _returns(spark, sf)
    stats = B.growth_stats(materialize(B.equity_curve(returns, "d"), "curve"), "d").withColumn("sharpe", B.sharpe(returns).scalar())
    return stats.select(rd("geometric_growth").alias("geometric_growth"), rd("log_return_sd").alias("log_return_sd"), rd("t_stat", 4).alias("t_stat"), "n", rd("sharpe", 4).alias("sharpe"))


# -- extension points -------------------------------------------------------------------------------

@query("U2_model_protocol")
def u2(spark, sf):
    model = model_protocol(lambda train, test: M.offset_logit_map(train, test, FEATS, "y", "p_side", 1.0))
    df = materialize(modelled(spark, sf).select("contest", "d", "side", "opp", "y", "p_side", *FEATS), "modelled")
    out = V.walk_forward(model, df, "d", n_splits=2, min_date="1998-01-01")
    return out.select("contest", "side", "opp", "fold", rd("y_pred").alias("y_pred"))


@query("U3_metric_columns", priced_sql(f"SELECT cls, {r('avg((y_pred - y) * (y_pred - y))')} AS brier, {r('max(abs(y_pred - p_side))')} AS widest FROM priced GROUP BY cls"))
def u3(spark, sf):
    gap = F.col("y_pred") - F.col("y")
    columns = metric_columns({"brier": rd(F.avg(gap * gap)), "widest": rd(F.max(F.abs(F.col("y_pred") - F.col("p_side"))))})
    return priced(spark, sf).groupBy("cls").agg(*columns)
