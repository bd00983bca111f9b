"""Walk-forward folds and metrics."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import _c
from ..session import materialize
from .aggs import dedupe_by_key
from .protocols import metric_columns, model_protocol

CLIP = 1e-15


def _folded(df, date, n_splits, dates_per_fold, min_date):
    dates = df.select(F.col(date).alias("_d")).where(F.col("_d").isNotNull())
    if min_date is not None:
        dates = dates.where(F.col("_d") >= F.lit(min_date).cast("date"))
    # Distinct dates are bounded by the calendar, so one window over them is small.
    ranked = dates.distinct().select("_d", (F.row_number().over(Window.orderBy("_d")) - 1).alias("_i"),
                                     F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    size = F.lit(dates_per_fold) if dates_per_fold else F.greatest(F.expr(f"cast(_n div {n_splits + 2} as int)"), F.lit(1))
    folds = ranked.select("_d", F.floor(F.col("_i") / size).cast("int").alias("fold"))
    return folds


def time_folds(df: DataFrame, date, n_splits=4, dates_per_fold=None, min_date=None) -> DataFrame:
    """Adds `fold`: whole dates in date order; null before `min_date`."""
    folds = _folded(df, date, n_splits, dates_per_fold, min_date)
    return df.join(folds, F.col(date) == F.col("_d"), "left").drop("_d")


def walk_forward(model, df: DataFrame, date, contest="contest", n_splits=4, dates_per_fold=None, min_date=None) -> DataFrame:
    """Each fold is predicted by a model of everything before it; one row per contest is kept. A row without a prediction
    raises while the predictions are written."""
    model = model_protocol(model)
    tagged = materialize(time_folds(df, date, n_splits, dates_per_fold, min_date), "folds")
    starts = tagged.where("fold is not null").groupBy("fold").agg(F.min(date).alias("start")).orderBy("fold").collect()
    first = tagged.agg(F.min(date)).first()[0]
    parts = None
    for row in starts:  # one entry per fold
        if first is None or row["start"] <= first:
            continue  # nothing earlier to learn from
        train = tagged.where(F.col(date) < F.lit(row["start"]))
        test = tagged.where(F.col("fold") == row["fold"])
        predicted = F.when(F.col("y_pred").isNull(), F.raise_error(F.lit("a model gave a null prediction")).cast("double")).otherwise(F.col("y_pred"))
        part = materialize(model.fit_predict(train, test).withColumn("y_pred", predicted), "pred")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return tagged.withColumn("y_pred", F.lit(None).cast("double")).where("false")
    return dedupe_by_key(parts, [contest], [])


def log_loss_of(y, p, clip=CLIP):
    q = F.least(F.greatest(_c(p), F.lit(clip)), F.lit(1 - clip))
    return F.avg(-(_c(y) * F.ln(q) + (1 - _c(y)) * F.ln(1 - q)))


def accuracy_of(y, p):
    return F.avg((F.bround(_c(p), 0) == _c(y)).cast("double"))


def flat_return_of(p, ps, po, y):
    """Net gain per unit bet; 0 without any bet. A price without odds (probability 0) is no bet."""
    p, ps, po, y = _c(p), _c(ps), _c(po), _c(y)
    on_side, on_opp = (p > ps) & (ps > 0), ((1 - p) > po) & (po > 0)
    gain = (
        F.when(on_side & (y == 1), F.try_divide(F.lit(1.0), ps) - 1).when(on_side & (y == 0), -1.0).otherwise(0.0)
        + F.when(on_opp & (y == 0), F.try_divide(F.lit(1.0), po) - 1).when(on_opp & (y == 1), -1.0).otherwise(0.0)
    )
    bets = F.sum(F.coalesce(on_side.cast("int"), F.lit(0)) + F.coalesce(on_opp.cast("int"), F.lit(0)))
    return F.when(bets == 0, 0.0).otherwise(F.try_divide(F.sum(gain), bets))


def kelly_growth_of(p, ps, po, y):
    """Product of 1 + return over rows; 0 as soon as one row loses everything. Prices without odds, or with odds that
    win nothing (probability 0 or 1), are no bet."""
    p, ps, po, y = _c(p), _c(ps), _c(po), _c(y)

    def stake(p, b):
        return F.when(b > 0, F.greatest(F.lit(0.0), p - F.try_divide(1 - p, b))).otherwise(0.0)

    b_side, b_opp = (F.when((q > 0) & (q < 1), F.try_divide(F.lit(1.0), q) - 1).otherwise(0.0) for q in (ps, po))
    k_side, k_opp = stake(p, b_side), stake(1 - p, b_opp)
    total = 1 + F.when(y == 1, k_side * b_side - k_opp).when(y == 0, k_opp * b_opp - k_side).otherwise(0.0)
    return F.when(F.min(total) <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(total > 0, total)))))


def fold_metrics(preds: DataFrame, metrics: dict = None, fold="fold", date="d", y="y", p="y_pred", market="p_side") -> DataFrame:
    """One row per fold: date range, counts, accuracy and log loss of model and market, and custom aggregates."""
    columns = {
        "min_date": F.min(date), "max_date": F.max(date), "n_days": F.count_distinct(date), "n_rows": F.count(F.lit(1)),
        "accuracy": accuracy_of(y, p), "log_loss": log_loss_of(y, p),
        "market_accuracy": accuracy_of(y, market), "market_log_loss": log_loss_of(y, market),
        **(metrics or {}),
    }
    return preds.where(F.col(fold).isNotNull()).groupBy(fold).agg(*metric_columns(columns))


def _grouped(df, by):
    return df.groupBy(*by) if by else df.groupBy()


def flat_stake_return(preds: DataFrame, p="y_pred", ps="p_side", po="p_opp", y="y", by=None) -> DataFrame:
    return _grouped(preds, by).agg(flat_return_of(p, ps, po, y).alias("flat_return"))


def kelly_growth(preds: DataFrame, p="y_pred", ps="p_side", po="p_opp", y="y", by=None) -> DataFrame:
    return _grouped(preds, by).agg(kelly_growth_of(p, ps, po, y).alias("kelly_growth"))


def _log_score(y, p):
    p = F.least(F.greatest(_c(p), F.lit(CLIP)), F.lit(1 - CLIP))
    return _c(y) * F.ln(p) + (1 - _c(y)) * F.ln(1 - p)


def paired_score_z(preds: DataFrame, y="y", p1="y_pred", p2="p_side") -> DataFrame:
    """Mean difference of two models' log scores over its standard error."""
    scored = preds.select((_log_score(y, p1) - _log_score(y, p2)).alias("s"))
    return scored.agg(F.avg("s").alias("mean_diff"),
                      F.try_divide(F.avg("s"), F.stddev_pop("s") / F.sqrt(F.count("s"))).alias("z"))


def loss_by_group(preds: DataFrame, y="y", p="y_pred", by="card_rank") -> DataFrame:
    return preds.groupBy(by).agg(log_loss_of(y, p).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def accuracy_log_loss(preds: DataFrame, y="y", p="y_pred", by=None) -> DataFrame:
    known = preds.where(_c(y).isNotNull() & _c(p).isNotNull())
    return _grouped(known, by).agg(accuracy_of(y, p).alias("accuracy"), log_loss_of(y, p).alias("log_loss"), F.count(F.lit(1)).alias("n"))
