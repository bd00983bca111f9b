"""Prices, probabilities and numeric features as Column expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import _c

# Clip range of a contest in seconds, body mass factor, fallback round length in seconds.
MIN_SECONDS, MAX_SECONDS = 60, 1500
BMI_FACTOR = 703
ROUND_SECONDS = 300


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(_c(c)), _c(c))


def american_to_prob(c) -> Column:
    x = _c(c).cast("double")
    return F.when(x <= 0, -x / (100 - x)).when(x > 0, 100 / (100 + x))


def american_to_payout(c) -> Column:
    """Profit per unit staked; a price of 0 is no price."""
    x = _c(c).cast("double")
    return F.when(x < 0, -100 / x).when(x > 0, x / 100)


def american_to_decimal(c) -> Column:
    return american_to_payout(c) + 1


def decimal_to_prob(c) -> Column:
    return F.try_divide(F.lit(1.0), _c(c).cast("double"))


def decimal_to_american(c) -> Column:
    x = _c(c).cast("double")
    return F.when(x >= 2, (x - 1) * 100).when((x > 1) & (x < 2), -100 / (x - 1))


def devig_pair(a, b) -> Column:
    total = _c(a) + _c(b)
    return F.struct(F.try_divide(_c(a), total).alias("side"), F.try_divide(_c(b), total).alias("opp"))


def strict_least(a, b) -> Column:
    """Null where either side is null."""
    return F.when(_c(a).isNotNull() & _c(b).isNotNull(), F.least(_c(a), _c(b)))


def strict_greatest(a, b) -> Column:
    return F.when(_c(a).isNotNull() & _c(b).isNotNull(), F.greatest(_c(a), _c(b)))


def worst_close(left, right) -> Column:
    """Lower implied probability of a closing range given as two American prices."""
    return strict_least(american_to_prob(left), american_to_prob(right))


def logit(c) -> Column:
    p = _c(c)
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))


def expit(c) -> Column:
    return 1 / (1 + F.exp(-_c(c)))


def line_movement(close, open_) -> Column:
    return logit(close) - logit(open_)


def best_price(cols) -> Column:
    cols = [_c(c) for c in cols]
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def consensus_prob(cols) -> Column:
    """Mean over the markets that quote; null where none does."""
    cols = [_c(c) for c in cols]
    total = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda x, y: x + y, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, count)


def clip_adjustment(p, market, bound=0.2) -> Column:
    """Market probability moved towards the model by at most `bound` on the logit scale."""
    shift = F.least(F.lit(float(bound)), F.greatest(F.lit(-float(bound)), logit(p) - logit(market)))
    return F.when(logit(p).isNotNull() & logit(market).isNotNull(), expit(logit(market) + shift))


def diff(a, b, fill=None) -> Column:
    out = _c(a) - _c(b)
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def sqrt_diff(a, b, fill=None) -> Column:
    root = lambda x: F.sqrt(F.when(_c(x) >= 0, _c(x)))
    return diff(root(a), root(b), fill)


def log_diff(a, b, floor=None, add=0.0, fill=None) -> Column:
    """ln(a + add) - ln(b + add); `floor` bounds both sides from below first."""
    def ln(x):
        x = _c(x) if floor is None else F.when(_c(x).isNotNull(), F.greatest(_c(x), F.lit(float(floor))))
        return F.ln(F.when(x + add > 0, x + add))
    return diff(ln(a), ln(b), fill)


def attempt_fail(att, landed) -> Column:
    missed = _c(att) - _c(landed)
    return F.when(missed.isNotNull(), F.greatest(missed, F.lit(0)))


def submission_counts(attempts, method, result, winner="W") -> Column:
    """struct(landed, attempted, fail): a submission win counts as one landed attempt."""
    landed = F.coalesce((_c(method) == "submission") & (_c(result) == winner), F.lit(False)).cast("int")
    return F.struct(
        landed.alias("landed"),
        strict_greatest(_c(attempts), landed).alias("attempted"),
        attempt_fail(attempts, landed).alias("fail"),
    )


def body_ratios(reach, height, weight) -> Column:
    return F.struct(
        F.try_divide(_c(reach), _c(height)).alias("ape_index"),
        (F.try_divide(_c(weight), _c(height) * _c(height)) * BMI_FACTOR).alias("bmi"),
    )


def stance_advantage(a, b) -> Column:
    """+1 for the rarer stance against orthodox, -1 the other way round."""
    common = lambda x: _c(x) == "orthodox"
    return F.when(~common(a) & common(b), 1).when(common(a) & ~common(b), -1).otherwise(0)


def signed_inverse_time(win, t, f="id") -> Column:
    """A win is -1 over time, a loss +1; null results stay null."""
    sign = F.when(_c(win) == 1, -1.0).when(_c(win) == 0, 1.0)
    clipped = F.when(_c(t).isNotNull(), F.least(F.greatest(_c(t), F.lit(MIN_SECONDS)), F.lit(MAX_SECONDS)))
    scale = {"id": lambda x: x, "sqrt": F.sqrt, "log": F.ln}[f]
    return sign / scale(clipped.cast("double"))


def contest_duration(arr, r, secs) -> Column:
    """Seconds: full rounds before the last one plus the time in the last one; 5-minute rounds without a format."""
    before = F.aggregate(F.slice(_c(arr), F.lit(1), F.greatest(_c(r) - 1, F.lit(0))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    r, secs = _c(r).cast("long"), _c(secs).cast("long")
    fallback = F.when(secs.isNull(), r * ROUND_SECONDS).otherwise((r - 1) * ROUND_SECONDS + secs)
    return F.coalesce(before * 60 + secs, fallback)


def outcome_targets(result, method) -> Column:
    """Targets from the result (W/L/D) and the four-class method."""
    win = F.when(_c(result) == "W", 1).when(_c(result) == "L", 0)
    sign = F.when(_c(result) == "W", 1).when(_c(result) == "L", -1).when(_c(result) == "D", 0)
    is_finish = _c(method).isin("submission", "tko_ko")
    score = F.when(is_finish, 2).when(_c(method) == "decision", 1).otherwise(0)
    flag = lambda cond: sign * cond.cast("int")
    return F.struct(
        win.alias("win"),
        F.when(is_finish, win).alias("win_finish"),
        (sign * score).alias("ordinal"),
        flag(_c(method) == "submission").alias("submission"),
        flag(_c(method) == "tko_ko").alias("tko_ko"),
        flag(_c(method) == "decision").alias("decision"),
        flag(is_finish).alias("finish"),
    )


def volume_index(strikes, takedowns) -> Column:
    return _c(strikes) + 10 * _c(takedowns)


def share_of_duration(seconds, seconds_opp, duration) -> Column:
    return F.coalesce(F.try_divide(_c(seconds) - _c(seconds_opp), _c(duration)), F.lit(0.0))


def accuracy_hat(y, n) -> Column:
    landed, tried = F.coalesce(_c(y), F.lit(0)), F.coalesce(_c(n), F.lit(0))
    return F.least(F.lit(1.0), landed / F.greatest(tried, F.lit(1)))
