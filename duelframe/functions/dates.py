"""Date columns: mixed formats, differences, buckets and decay weights."""

import math

from pyspark.sql import Column, functions as F

from .text import _c

# Fixed value: days per month used by the decay weight.
DAYS_PER_MONTH = 30.5


def parse_mixed_date(c, formats) -> Column:
    """Formats are tried in order; a trailing `(33)` is removed first."""
    text = F.trim(F.regexp_replace(_c(c), r"\s*\(\d+\)$", ""))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def days_between(a, b) -> Column:
    return F.datediff(_c(a), _c(b))


def hours_between(later, earlier, floor=None) -> Column:
    """Hours as a double; `floor` clips from below so that a logarithm stays defined."""
    seconds = F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))
    hours = seconds / F.lit(3_600_000_000.0)
    return hours if floor is None else F.greatest(hours, F.lit(float(floor)))


def week_bucket(c, iso_only=False) -> Column:
    """Monday of the week; `iso_only` gives the bare ISO week number, which merges years."""
    return F.weekofyear(_c(c)) if iso_only else F.date_trunc("week", _c(c)).cast("date")


def period_key(d, contest) -> Column:
    """One period per contest, still ordered by date."""
    return F.concat(_c(d).cast("string"), F.lit("_"), _c(contest))


def decay_weight(d, ref, rate) -> Column:
    """(1 - rate) per month of distance to `ref`; rows at `ref` weigh 1."""
    return F.exp(F.lit(math.log(1 - rate)) * F.datediff(_c(ref), _c(d)) / F.lit(DAYS_PER_MONTH))
