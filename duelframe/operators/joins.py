"""Joins on contest tables.

Lookups bring one row per key, so Spark may split a hot key of the large side freely. Joins where both sides
repeat a key carry the date in the join key, so a hot entity spreads over its dates and pairs outside the
date tolerance are never formed.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..keys import Keys
from ..session import discard, materialize
from .aggs import dedupe_best_row, dedupe_by_key, first_nonnull, last_nonnull, mark_duplicates
from .checks import RowCounts, RowsChanged
from .rows import both_orientations


def with_suffix(df: DataFrame, suffix, keep=()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else c + suffix) for c in df.columns])


def _same(left_cols, right_cols, null_safe=False):
    pairs = [(F.col(a), F.col(b)) for a, b in zip(left_cols, right_cols)]
    return [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]


# Pieces over which rows without a key are spread in an outer join.
NULL_SPREAD = 512


def _within(a, b):
    """Equality that Spark does not take for a join key."""
    return (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))


def _within_or_null(a, b):
    return _within(a, b) | (F.col(a).isNull() & F.col(b).isNull())


def left_lookup(df: DataFrame, right: DataFrame, left_cols, right_cols, null_safe=False, spread_nulls=False, bucket=None) -> DataFrame:
    """Left join that adds the other columns of `right`; `right` has one row per key.

    `spread_nulls` is for keys that are null on many rows: those rows match nothing, so they are sent to many
    tasks instead of one. `bucket` names the left key column by which both tables are bucketed: they are joined where
    they lie, the other keys compared within the few rows of one bucket value. Spark would move both for all keys. With
    `null_safe` the other keys may be null there, the bucket key may not.
    """
    renamed = right.select(*[F.col(c).alias(f"_r{right_cols.index(c)}" if c in right_cols else c) for c in right.columns])
    keys = [f"_r{i}" for i in range(len(right_cols))]
    if bucket is not None:
        if spread_nulls:
            raise ValueError("bucketed lookups spread no nulls")
        other = _within_or_null if null_safe else _within
        on = [F.col(a) == F.col(b) if a == bucket else other(a, b) for a, b in zip(left_cols, keys)]
        return df.join(renamed, on, "left").drop(*keys)
    if not spread_nulls:
        return df.join(renamed, _same(left_cols, keys, null_safe), "left").drop(*keys)
    missing = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in left_cols])
    piece = F.when(missing, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(NULL_SPREAD)) + 1).otherwise(F.lit(0))
    spread = df.withColumn("_piece", piece.cast("int"))
    renamed = renamed.withColumn("_at", F.lit(0))
    on = [*_same(left_cols, keys), F.col("_piece") == F.col("_at")]
    return spread.join(renamed, on, "left").drop(*keys, "_piece", "_at")


def double_contests(df: DataFrame, keys: Keys, pairs: dict, outcome=None) -> DataFrame:
    """One row per contest key, then its swapped copy: exactly two rows per contest."""
    return both_orientations(dedupe_by_key(df, [keys.contest], [keys.side, keys.opp]), pairs, outcome)


def attach_both_sides(df: DataFrame, right: DataFrame, on, keys: Keys = Keys(), suffix="_opp", null_safe=False, bucket=None) -> DataFrame:
    """Attach a per-(on, entity) table to the side and, with a suffix, to the opponent; for `bucket` see `left_lookup`."""
    on = [on] if isinstance(on, str) else list(on)
    key_cols = [*on, keys.side]
    out = left_lookup(df, right, key_cols, key_cols, null_safe, bucket=bucket)
    return left_lookup(out, with_suffix(right, suffix, key_cols), [*on, keys.opp], key_cols, null_safe, bucket=bucket)


def three_source_join(canon: DataFrame, sources, upcoming: DataFrame = None, keys: Keys = Keys()) -> DataFrame:
    """Canonical contests <- contest map <- auxiliary tables, then future contests appended.

    `sources` holds (aux, contest_map, suffix); the map has side, opp, date with the suffix and without.
    """
    base = [keys.side, keys.opp, keys.date]
    out, written = canon, None
    for n, (aux, contest_map, suffix) in enumerate(sources):
        if n:  # what the sources before have moved need not stay until all are joined
            before, written = written, materialize(out, "joined")
            discard(before)
            out = written
        ids = [c + suffix for c in base]
        out = left_lookup(out, contest_map.select(*base, *ids), base, base)
        out = left_lookup(out, with_suffix(aux, suffix), ids, ids, spread_nulls=True)  # unmapped contests have no ids
    out = out.withColumn("is_upcoming", F.lit(False))
    if upcoming is not None:
        out = out.unionByName(upcoming.withColumn("is_upcoming", F.lit(True)), allowMissingColumns=True)
    return out


def assemble(canon: DataFrame, stats: DataFrame, stats_map: DataFrame, prices: DataFrame, price_map: DataFrame, upcoming: DataFrame = None,
             id_map: DataFrame = None, keys: Keys = Keys()) -> tuple:
    """(table, rows by lookup): canonical contests with the statistics and prices of sources that use ids of their own.

    The maps have side, opp, date of the source, with the suffixes `_stats` and `_prices`, and of the canon. Statistics come
    once for a row of the canon, which is counted while the table is written, and a map or source that repeats a key
    raises. `upcoming` contests in the statistics' ids are translated by `id_map` and must find both entities. Markets may
    list a contest more than once: those rows are kept and marked (`is_dup`). The contest key fills every row.
    """
    base = [keys.side, keys.opp, keys.date]
    guard, own = RowCounts(), lambda suffix: [c + suffix for c in base]
    found = guard.around(with_suffix(stats, "_stats"), lambda df: left_lookup(df, stats_map.select(*own("_stats"), *base), own("_stats"), own("_stats")), "map of statistics")
    # Statistics of contests that the canon lacks go. Both sources are written, so that what they move need not stay until the end.
    found = materialize(found.na.drop(subset=base), "statistics")
    out = guard.around(canon, lambda df: left_lookup(df, found, base, base), "statistics")
    out = out.withColumn("is_upcoming", F.lit(False))
    if upcoming is not None:
        ids = upcoming
        for c in (keys.side, keys.opp):
            ids = guard.around(ids, lambda df, c=c: map_column(df, c, id_map, c), f"ids of upcoming {c}")
        known = F.col(keys.side).isNotNull() & F.col(keys.opp).isNotNull()
        checked = F.when(known, F.lit(True)).otherwise(F.raise_error(F.lit("an upcoming contest has an unknown entity")).cast("boolean"))
        out = out.unionByName(ids.withColumn("is_upcoming", checked), allowMissingColumns=True)
    marked = with_suffix(prices, "_prices").join(price_map.select(*own("_prices"), *base), own("_prices"))
    marked = materialize(mark_duplicates(marked, base, "is_dup"), "prices")
    out = left_lookup(out, marked, base, base)
    out = out.withColumns({"is_dup": F.coalesce("is_dup", F.lit(False)), keys.contest: contest_key_of(keys)})
    table = materialize(out, "assembled")
    discard(found, marked)
    counts = guard.verify()
    if not table.where("not is_dup").groupBy(*base).count().where("count > 1").isEmpty():
        raise RowsChanged("contests repeat that the prices do not explain")
    return table, counts


def contest_key_of(keys: Keys):
    date = F.date_format(keys.date, "yyyy-MM-dd")
    sides = [F.col(keys.side).cast("string"), F.col(keys.opp).cast("string")]
    return F.concat_ws("_", date, F.least(*sides), F.greatest(*sides))


def best_rows(table: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Of the rows that the prices repeat, the one with the fewest nulls for each side of a contest."""
    return dedupe_best_row(table, [keys.contest, keys.side, keys.opp])


def _day(c):
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def tolerant_date_join(left: DataFrame, right: DataFrame, on, l_date, r_date, tol_days, how="inner") -> DataFrame:
    """Equal keys and dates at most `tol_days` apart. `on` lists (left, right) names; all names must be distinct.

    Dates are cut into stretches of `STRETCH` times (tol + 1) days: a left row lies in one, a right row is offered to the
    one or two (with that width) that its tolerance reaches. The stretch is part of the equi-join key, so a hot key never
    meets itself over all dates. As right rows may be offered twice, `how` must not keep unmatched ones.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti", "semi", "anti"):
        raise ValueError(f"{how!r} would repeat unmatched right rows; swap the sides")
    same = [F.col(a) == F.col(b) for a, b in on]
    if tol_days == 0:
        return left.join(right, same + [F.col(l_date) == F.col(r_date)], how)
    l_cut = left.withColumn("_lb", stretch(F.col(l_date), tol_days))
    r_cut = right.withColumn("_rb", F.explode(offered_stretches(F.col(r_date), tol_days)))
    near = F.abs(F.datediff(l_date, r_date)) <= tol_days
    return l_cut.join(r_cut, same + [F.col("_lb") == F.col("_rb"), near], how).drop("_lb", "_rb")


# A stretch of days, in tolerances and a day: wider ones offer fewer rows twice, narrower ones let fewer rows meet.
STRETCH = 4


def stretch(date, tol_days):
    """Number of the stretch a date lies in; without a tolerance a stretch is a day."""
    return F.floor(_day(date) / (STRETCH * (tol_days + 1) if tol_days else 1))


def offered_stretches(date, tol_days):
    """All stretches that hold a day within the tolerance."""
    return F.sequence(stretch(F.date_sub(date, tol_days), tol_days), stretch(F.date_add(date, tol_days), tol_days))


def jitter_date_join(left: DataFrame, right: DataFrame, on, date, tol_days, how="inner") -> DataFrame:
    """The left row is repeated for every day within the tolerance and joined on the exact date.

    The matched date is `date`, the left row's own one is kept as `<date>_orig`.
    """
    spread = left.withColumn(f"{date}_orig", F.col(date)).withColumn(
        date, F.explode(F.sequence(F.date_sub(date, tol_days), F.date_add(date, tol_days))))
    return spread.join(right, [*on, date], how)


def orientation_join(df: DataFrame, odds: DataFrame, keys: Keys, pairs: dict) -> DataFrame:
    """Prices quoted in either orientation reach both rows of a contest; no base row is lost."""
    on = [keys.side, keys.opp, keys.date]
    both = both_orientations(odds, {**pairs, keys.side: keys.opp})
    one = dedupe_by_key(both, on, [])
    return left_lookup(df, one, on, on)


def prop_join(props: DataFrame, names: DataFrame, on, marker="Event") -> tuple:
    """Attach entity references by (name, `on`) to both sides; returns (event-level rows, contest-level rows)."""
    on = [on] if isinstance(on, str) else list(on)
    side = names.withColumnsRenamed({"name": "side_name", "href": "side_href"})
    opp = names.withColumnsRenamed({"name": "opp_name", "href": "opp_href"})
    at_event = (F.col("side_name") == marker) & (F.col("opp_name") == marker)
    in_contest = (F.col("side_name") != marker) & (F.col("opp_name") != marker)
    # Event-level rows have no entities to attach, so they take no part in the joins.
    contests = props.where(in_contest).join(side, [*on, "side_name"], "left").join(opp, [*on, "opp_name"], "left")
    return props.where(at_event).drop("side_name", "opp_name"), contests


def pair_merge_first_last(df: DataFrame, by, order, side="_side", opp="_opp") -> DataFrame:
    """First and last row of a block become side and opponent: one aggregation instead of a self-join."""
    values = [c for c in df.columns if c not in by and c not in order]
    return df.groupBy(*by).agg(
        *[first_nonnull(c, order).alias(c + side) for c in values],
        *[last_nonnull(c, order).alias(c + opp) for c in values],
    )


def outcome_pivot_join(df: DataFrame, keys, outcome, price, side="side", opp="opp") -> DataFrame:
    """One row per snapshot key with the price of each side's outcome; keys lacking one of the two are dropped, other
    outcomes (a draw) are ignored."""
    is_side, is_opp = F.col(outcome) == F.col(side), F.col(outcome) == F.col(opp)
    return df.groupBy(*keys).agg(
        F.max(F.when(is_side, F.col(price))).alias(f"side_{price}"),
        F.max(F.when(is_opp, F.col(price))).alias(f"opp_{price}"),
        F.count_if(is_side).alias("_s"), F.count_if(is_opp).alias("_o"),
    ).where("_s > 0 and _o > 0").drop("_s", "_o")


def open_close_join(df: DataFrame, keys, ts, values) -> DataFrame:
    """First and last snapshot per key in one pass."""
    return df.groupBy(*keys).agg(
        F.min(ts).alias(f"open_{ts}"), F.max(ts).alias(f"close_{ts}"),
        *[first_nonnull(v, ts).alias(f"open_{v}") for v in values],
        *[last_nonnull(v, ts).alias(f"close_{v}") for v in values],
    )


def semi_anti_membership(df: DataFrame, col, ids_df: DataFrame, keep=True) -> DataFrame:
    ids = ids_df.select(F.col(ids_df.columns[0]).alias("_id")).distinct()
    return df.join(ids, F.col(col) == F.col("_id"), "left_semi" if keep else "left_anti")


def map_column(df: DataFrame, col, map_df: DataFrame, out) -> DataFrame:
    names = map_df.toDF("_from", "_to")
    return df.join(names, F.col(col) == F.col("_from"), "left").withColumn(out, F.col("_to")).drop("_from", "_to")


def upcoming_enrich(df: DataFrame, maps: DataFrame, bios: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Future contests: both ids translated (unknown ids stay), then both bios attached."""
    out = map_column(df, keys.side, maps, "_s")
    out = map_column(out, keys.opp, maps, "_o")
    out = out.withColumns({keys.side: F.coalesce("_s", keys.side), keys.opp: F.coalesce("_o", keys.opp)}).drop("_s", "_o")
    out = left_lookup(out, bios, [keys.side], [bios.columns[0]])
    return left_lookup(out, with_suffix(bios, "_opp"), [keys.opp], [bios.columns[0] + "_opp"])


def close_line_join(df: DataFrame, close: DataFrame, on) -> DataFrame:
    return df.join(close, list(on), "left")


def feature_join(df: DataFrame, feats: DataFrame, keys: Keys = Keys(), bucket=None) -> DataFrame:
    """Left join of features by row key; a feature named like a column of `df` is refused. For `bucket` see `left_lookup`."""
    clash = sorted(set(feats.columns) & set(df.columns) - set(keys.row))
    if clash:
        raise ValueError(f"columns {clash} are on both sides")
    if bucket is not None:
        return left_lookup(df, feats, keys.row, keys.row, bucket=bucket)
    return df.join(feats, keys.row, "left")


def multi_table_inner(dfs, on) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on), "inner"), dfs)
