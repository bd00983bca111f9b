"""Stakes, settlement and returns as columns and aggregates over contest tables."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import _c
from ..session import HOT_ROWS, materialize
from .careers import Run, with_running


def kelly_fraction(p, dec_odds) -> Column:
    """Share of the bankroll; no price, no stake."""
    b = _c(dec_odds) - 1
    return F.coalesce(F.greatest(F.lit(0.0), _c(p) - F.try_divide(1 - _c(p), b)), F.lit(0.0))


def with_kelly(df: DataFrame, p="y_pred", side_odds="side_odds", opp_odds="opp_odds") -> DataFrame:
    """Shares of both sides; a contest that lacks either price takes no part, as it cannot be sized against the others."""
    df = df.where(F.col(side_odds).isNotNull() & F.col(opp_odds).isNotNull())
    return df.withColumns({"kelly_side": kelly_fraction(p, side_odds), "kelly_opp": kelly_fraction(1 - _c(p), opp_odds)})


def period_stakes(df: DataFrame, period, cap=1.0, written=False) -> DataFrame:
    """Kelly shares split over the positive bets of the period and capped.

    `both_sides` flags rows that back both entities, `over_bankroll` periods whose stakes reach the bankroll.
    The totals are aggregated per period and joined back, so a period of any size stays distributed. Totals by date are
    broadcast, as there are at most as many as days in the calendar: the rows stay where they are. The rows are written
    first, as they are read for the number of bets, for the stakes and for the result; not if they are read from a table
    (`written`), whose buckets they keep.
    """
    df = df if written else materialize(df, "stakes")
    small = F.broadcast if dict(df.dtypes)[period] == "date" else lambda totals: totals
    totals = small(df.groupBy(period).agg(
        F.sum((F.col("kelly_side") > 0).cast("int") + (F.col("kelly_opp") > 0).cast("int")).alias("n_bets")))
    staked = df.join(totals, period, "left").withColumns({
        f"stake_{s}": F.when(F.col("n_bets") > 0, F.least(F.lit(float(cap)), F.col(f"kelly_{s}") / F.col("n_bets"))).otherwise(0.0)
        for s in ("side", "opp")})
    over = small(staked.groupBy(period).agg((F.sum(F.col("stake_side") + F.col("stake_opp")) >= 1).alias("over_bankroll")))
    return staked.withColumn("both_sides", (F.col("kelly_side") > 0) & (F.col("kelly_opp") > 0)).join(over, period, "left")


def settle_bets(df: DataFrame, y="y", side_odds="side_odds", opp_odds="opp_odds") -> DataFrame:
    """Profit per side; a contest without an outcome returns both stakes."""
    y = _c(y)
    side = F.coalesce(F.col(side_odds) * F.col("stake_side") * y - F.col("stake_side"), F.lit(0.0))
    opp = F.coalesce(F.col(opp_odds) * F.col("stake_opp") * (1 - y) - F.col("stake_opp"), F.lit(0.0))
    return df.withColumns({"profit_side": side, "profit_opp": opp}).withColumn("profit", F.col("profit_side") + F.col("profit_opp"))


def period_returns(df: DataFrame, period) -> DataFrame:
    return df.groupBy(period).agg(
        F.sum("profit").alias("ret"), F.sum(F.col("stake_side") + F.col("stake_opp")).alias("staked"),
        F.count(F.lit(1)).alias("n"))


def equity_curve(df: DataFrame, period, r="ret", start=1.0, hot_rows=HOT_ROWS) -> DataFrame:
    """Running product of 1 + return; periods may be as many as contests, hence the chunked running sum.

    The periods are written first, as they are counted and then run through."""
    df = materialize(df, "periods")
    growth = 1 + _c(r)
    ran = with_running(
        df.withColumn("_log", F.ln(F.when(growth > 0, growth))).withColumn("_bust", (growth <= 0).cast("int")),
        [], period, {"_sum": Run("sum", "_log", default=0.0), "_dead": Run("max", "_bust")}, hot_rows)
    value = F.when(F.col("_dead") == 1, F.lit(0.0)).otherwise(F.lit(float(start)) * F.exp("_sum"))
    return ran.withColumn("portfolio", value).drop("_log", "_bust", "_sum", "_dead")


def growth_stats(df: DataFrame, period, value="portfolio", hot_rows=HOT_ROWS) -> DataFrame:
    """One row: geometric mean growth, standard deviation and t-statistic of log returns between periods."""
    per = materialize(df.groupBy(period).agg(F.max(value).alias("_v")), "periods")
    ran = with_running(per.withColumn("_l", F.ln(F.when(F.col("_v") > 0, F.col("_v")))), [], period, {"_p": Run("lag", "_l")}, hot_rows)
    d = F.col("_l") - F.col("_p")
    return ran.select(d.alias("x")).agg(
        (F.exp(F.avg("x")) - 1).alias("geometric_growth"), F.stddev_samp("x").alias("log_return_sd"),
        F.try_divide(F.avg("x"), F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("t_stat"), F.count("x").alias("n"))


def sharpe(df: DataFrame, r="ret") -> DataFrame:
    """Mean return over its standard error."""
    return df.agg(F.try_divide(F.avg(r), F.stddev_samp(r) / F.sqrt(F.count(r))).alias("sharpe"))
