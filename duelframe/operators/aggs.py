"""Aggregations per key.

Keyed reductions are plain aggregates or `row_number() = 1`; Spark reduces both inside each map task before
the shuffle, so a hot key reaches its reducer as at most one row per map task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.odds import logit
from ..session import BROADCAST_ROWS, materialize


def _at(order):
    return F.struct(*([order] if isinstance(order, (str, Column)) else order))


def first_nonnull(col, order) -> Column:
    return F.min_by(col, F.when(F.col(col).isNotNull(), _at(order)))


def last_nonnull(col, order) -> Column:
    return F.max_by(col, F.when(F.col(col).isNotNull(), _at(order)))


def first_nonnull_by_key(df: DataFrame, keys, order) -> DataFrame:
    """First non-null value per column, not the first row."""
    return df.groupBy(*keys).agg(*[first_nonnull(c, order).alias(c) for c in df.columns if c not in keys])


def first_last_by_key(df: DataFrame, keys, order, values) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[first_nonnull(v, order).alias(f"first_{v}") for v in values],
        *[last_nonnull(v, order).alias(f"last_{v}") for v in values],
    )


def count_distinct_per_key(df: DataFrame, keys, col, name="n_distinct") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(col).alias(name))


def value_counts(df: DataFrame, cols) -> DataFrame:
    return df.na.drop(how="any", subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)


def histogram_of_counts(df: DataFrame, cols) -> DataFrame:
    return value_counts(df, cols).groupBy("n").agg(F.count(F.lit(1)).alias("n_keys"))


def pooled_rate_logit(df: DataFrame, num_cols, den_cols) -> DataFrame:
    """One row: logit of the pooled rate over all pairs; a row counts only where both parts are present."""
    return df.agg(pooled_rate_logit_of(num_cols, den_cols).alias("logit_rate"))


def pooled_rate_logit_of(num_cols, den_cols):
    """The same as an aggregate, so that many rates share one scan."""
    pairs = list(zip(num_cols, den_cols))
    part = lambda c, n, d: F.coalesce(F.sum(F.when(F.col(n).isNotNull() & F.col(d).isNotNull(), F.col(c))), F.lit(0))
    total = lambda pick: reduce(lambda x, y: x + y, [part(pick(n, d), n, d) for n, d in pairs])
    return logit(F.try_divide(total(lambda n, d: n), total(lambda n, d: d)))


def sum_by_period(df: DataFrame, period, cols, max_cols=()) -> DataFrame:
    return df.groupBy(period).agg(*[F.sum(c).alias(f"sum_{c}") for c in cols], *[F.max(c).alias(f"max_{c}") for c in max_cols])


def group_stddev(df: DataFrame, cols, by=None) -> DataFrame:
    """Divide each column by the sample standard deviation of its group (`by`) or of the whole table."""
    stds = [F.stddev_samp(c).alias(f"_sd_{c}") for c in cols]
    if by is None:
        totals = df.agg(*stds)
        joined = df.withColumns({f"_sd_{c}": totals.select(f"_sd_{c}").scalar() for c in cols})
    else:
        # Few large groups would land in as few tasks: their deviations go to the rows instead.
        df = materialize(df, "grouped")  # read twice
        found = materialize(df.groupBy(by).agg(*stds), "deviations")
        joined = df.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, by, "left")
    return joined.select(*df.columns, *[F.try_divide(F.col(c), F.col(f"_sd_{c}")).alias(f"{c}_scaled") for c in cols])


def rms_scale(df: DataFrame, cols) -> DataFrame:
    return df.agg(*[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}") for c in cols])


def dedupe_by_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in `order`, ties broken by all columns so that the choice is repeatable."""
    named = {c for c in order if isinstance(c, str)}
    ties = [F.col(c) for c in df.columns if c not in keys and c not in named]
    w = Window.partitionBy(*keys).orderBy(*order, *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_best_row(df: DataFrame, keys) -> DataFrame:
    from .rows import row_null_share

    tagged = df.withColumn("_nulls", row_null_share(df.columns))
    return dedupe_by_key(tagged, keys, ["_nulls"]).drop("_nulls")


def dedupe_exact(df: DataFrame) -> DataFrame:
    return df.distinct()


def mark_duplicates(df: DataFrame, keys, name="is_dup") -> DataFrame:
    """Flag every member of a key that occurs more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marks = many.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_dup"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(marks, same, "left").select(*df.columns, F.coalesce("_dup", F.lit(False)).alias(name))
