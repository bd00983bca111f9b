"""Row-wise operators: swaps, maps, fills and filters."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import _c
from ..keys import Keys


def side_pairs(columns, side="_side", opp="_opp") -> dict:
    """Every `x_side` that has an `x_opp` next to it."""
    return {c: c[: -len(side)] + opp for c in columns if c.endswith(side) and c[: -len(side)] + opp in columns}


def swap_sides(df: DataFrame, pairs: dict) -> DataFrame:
    other = {**pairs, **{v: k for k, v in pairs.items()}}
    return df.select(*[F.col(other.get(c, c)).alias(c) for c in df.columns])


def both_orientations(df: DataFrame, pairs: dict, outcome=None) -> DataFrame:
    """Every row and its swapped copy from one pass: the input is not computed twice.

    Columns outside the pairs stay outside the generated part, so filters on them still reach the scan.
    """
    other = {**pairs, **{v: k for k, v in pairs.items()}}
    moving = [c for c in df.columns if c in other]
    flipped = [] if outcome is None else [outcome]
    own = F.struct(*[F.col(c).alias(c) for c in moving + flipped])
    swapped = F.struct(*[F.col(other[c]).alias(c) for c in moving], *[flip_outcome(c).alias(c) for c in flipped])
    still = [c for c in df.columns if c not in moving + flipped]
    out = df.select(*still, F.explode(F.array(own, swapped)).alias("_r"))
    return out.select(*[F.col(c) if c in still else F.col(f"_r.{c}").alias(c) for c in df.columns])


def flip_outcome(c, kind="wld") -> Column:
    c = _c(c)
    if kind == "wld":
        return F.when(c == "W", "L").when(c == "L", "W").otherwise(c)
    if kind == "win_loss":
        return F.when(c == "win", "loss").otherwise(c)
    if kind == "binary":
        return 1 - c
    if kind == "sign":
        return -c
    raise ValueError(f"unknown outcome kind {kind!r}")


def map_values(df: DataFrame, col, map_df: DataFrame, default=None, out=None) -> DataFrame:
    """Total map by a (from, to) table with one row per `from`; values without an entry become `default`."""
    names = map_df.toDF("_from", "_to")
    joined = df.join(names, F.col(col) == F.col("_from"), "left")
    value = F.col("_to") if default is None else F.coalesce("_to", F.lit(default))
    return joined.withColumn(out or col, value).drop("_from", "_to")


def overwrite_values(df: DataFrame, cols, map_df: DataFrame, keep="_pre_overwrite") -> DataFrame:
    """Partial map: values without an entry stay; the original is kept under `<col><keep>`."""
    for col in cols:
        names = map_df.toDF("_from", "_to")
        joined = df.join(names, F.col(col) == F.col("_from"), "left").withColumn(col + keep, F.col(col))
        df = joined.withColumn(col, F.coalesce("_to", col)).drop("_from", "_to")
    return df


def drop_listed_pairs(df: DataFrame, listed_df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Remove listed (date, a, b) contests in either orientation."""
    listed = listed_df.toDF("_d", "_a", "_b").select(
        "_d", F.least("_a", "_b").alias("_lo"), F.greatest("_a", "_b").alias("_hi")).distinct()
    same = (
        (F.col(keys.date) == F.col("_d"))
        & (F.least(keys.side, keys.opp) == F.col("_lo"))
        & (F.greatest(keys.side, keys.opp) == F.col("_hi"))
    )
    return df.join(listed, same, "left_anti")


def drop_listed_keys(df: DataFrame, listed_df: DataFrame, key) -> DataFrame:
    return df.join(listed_df.select(F.col(listed_df.columns[0]).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def dropna_subset(df: DataFrame, cols) -> DataFrame:
    return df.na.drop(how="any", subset=list(cols))


def keep_complete_or_flag(df: DataFrame, cols, flag) -> DataFrame:
    complete = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols])
    return df.where(complete | F.coalesce(_c(flag).cast("boolean"), F.lit(False)))


def _mean(conditions) -> Column:
    return reduce(lambda x, y: x + y, [c.cast("int") for c in conditions]) / F.lit(float(len(conditions)))


def row_null_share(cols) -> Column:
    return _mean([F.col(c).isNull() for c in cols])


def row_zero_share(cols) -> Column:
    return _mean([F.coalesce(F.col(c), F.lit(0)) == 0 for c in cols])


def row_all_null(cols) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNull() for c in cols])


def fill_from(df: DataFrame, fallbacks: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), _c(f)) for c, f in fallbacks.items()})


def is_member(df: DataFrame, ids_df: DataFrame, cols, name) -> DataFrame:
    """True where any of `cols` is in the id set."""
    ids = ids_df.select(F.col(ids_df.columns[0]).alias("_id")).where("_id is not null").distinct()
    out, flags = df, []
    for i, col in enumerate(cols):
        hit = ids.select(F.col("_id").alias(f"_id{i}"))
        out = out.join(hit, F.col(col) == F.col(f"_id{i}"), "left")
        flags.append(F.col(f"_id{i}").isNotNull())
    return out.select(*df.columns, reduce(lambda x, y: x | y, flags).alias(name))


def date_query(df: DataFrame, col, start=None, end=None, **equals) -> DataFrame:
    """Dates in [start, end) and equalities; literals keep the type of the column so that they reach the scan."""
    conditions = []
    kind = dict(df.dtypes)[col]
    if start is not None:
        conditions.append(F.col(col) >= F.lit(start).cast(kind))
    if end is not None:
        conditions.append(F.col(col) < F.lit(end).cast(kind))
    conditions += [F.col(c) == F.lit(v) for c, v in equals.items()]
    return df.where(reduce(lambda x, y: x & y, conditions)) if conditions else df


def column_audit(df: DataFrame) -> DataFrame:
    """One row per column with its non-null count and null share; a single pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_present")) for c in df.columns]))
    return counts.select("_rows", entries.alias("e")).select(
        "e.column", "e.n_present", (1 - F.try_divide("e.n_present", "_rows")).alias("null_share"))
