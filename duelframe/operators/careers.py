"""Career features: running values of an entity in date order.

`with_running` is the only place that orders rows inside a group. Groups of ordinary size go through
one window per entity. An entity with more than `hot_rows` rows is cut into ordered chunks: every chunk
is scanned by its own task, the chunk totals are carried forward, and both parts are combined, so no
task ever sees a whole hot group.
"""

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import _c
from ..keys import Keys
from ..session import HOT_ROWS, materialize


@dataclass(frozen=True)
class Run:
    """One running value. `kind`: count, sum, min, max, last (non-null), lag, lead, prior_total."""
    kind: str
    value: Any = None
    inclusive: bool = True
    default: Any = None
    mask: bool = False


def _local(spec: Run, entity, order) -> Column:
    w = Window.partitionBy(*entity).orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    if spec.kind == "count":
        return F.count(F.lit(1) if spec.value is None else _c(spec.value)).over(frame)
    value = _c(spec.value)
    if spec.kind in ("lag", "lead"):
        return {"lag": F.lag, "lead": F.lead}[spec.kind](F.struct(value.alias("v"))).over(w)
    if spec.kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.kind](value).over(frame)


def _total(spec: Run, order) -> Column:
    """What one chunk hands to its neighbours."""
    at = F.struct(*order)
    if spec.kind == "count":
        return F.count(F.lit(1) if spec.value is None else _c(spec.value))
    value = _c(spec.value)
    if spec.kind == "lag":
        return F.max_by(F.struct(value.alias("v")), at)
    if spec.kind == "lead":
        return F.min_by(F.struct(value.alias("v")), at)
    if spec.kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), at))
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.kind](value)


def _carry(spec: Run, name, entity) -> Column:
    w = Window.partitionBy(*entity).orderBy("_chunk")
    if spec.kind in ("lag", "lead"):
        return {"lag": F.lag, "lead": F.lead}[spec.kind](name).over(w)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind == "last":
        return F.last(name, ignorenulls=True).over(before)
    return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[spec.kind](name).over(before)


def _combine(spec: Run, local: Column, carry: Column) -> Column:
    if spec.kind in ("count", "sum"):
        return F.coalesce(local + carry, local, carry)
    if spec.kind == "min":
        return F.least(local, carry)
    if spec.kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def _parts(spec: Run):
    if spec.kind == "prior_total":
        return {"sum": Run("sum", spec.value, inclusive=False), "lag": Run("lag", spec.value)}
    return {"it": spec}


def _finish(spec: Run, got) -> Column:
    if spec.kind == "prior_total":
        # A missing summand blanks the total of the next row, and a blank total reads as 0.
        out = F.when(got["lag"]["v"].isNotNull(), got["sum"])
    else:
        out = got["it"]["v"] if spec.kind in ("lag", "lead") else got["it"]
    if spec.mask:
        out = F.when(_c(spec.value).isNotNull(), out)
    return out if spec.default is None else F.coalesce(out, F.lit(spec.default))


def _chunked(df, entity, order, prims, n_chunks) -> DataFrame:
    ranged = df.repartitionByRange(n_chunks, *entity, *order)
    # Written once: the chunk numbers must not change between the two uses below.
    tagged = materialize(ranged.withColumn("_chunk", F.spark_partition_id()), "chunks")
    totals = tagged.groupBy(*entity, "_chunk").agg(*[_total(s, order).alias(n) for n, s in prims.items()])
    names = {e: f"_e{i}" for i, e in enumerate(entity)}
    carried = totals.select(*[F.col(e).alias(n) for e, n in names.items()], F.col("_chunk").alias("_at"),
                            *[_carry(s, n, entity).alias("c" + n) for n, s in prims.items()])
    local = tagged.select("*", *[_local(s, [*entity, "_chunk"], order).alias("l" + n) for n, s in prims.items()])
    # At most one row per chunk border plus one per hot entity, hence small by construction.
    same = [F.col("_chunk") == F.col("_at"), *[F.col(e).eqNullSafe(F.col(n)) for e, n in names.items()]]
    joined = local.join(F.broadcast(carried), same)
    return joined.select(*df.columns, *[_combine(s, F.col("l" + n), F.col("c" + n)).alias(n) for n, s in prims.items()])


def with_running(df: DataFrame, entity, order, specs: dict, hot_rows=HOT_ROWS, sized_by: DataFrame = None) -> DataFrame:
    """Add one column per `Run`. `order` names ascending columns that should end in a unique key.

    Group sizes are counted first, on `sized_by` where a cheaper table with at least the same rows exists;
    `hot_rows=None` skips the count where groups are known to be small. Rows whose entity is null form one
    group, as in any grouping; drop them first where they must not.
    """
    entity = [entity] if isinstance(entity, str) else list(entity)
    order = [order] if isinstance(order, str) else list(order)
    columns = df.columns
    if not entity:
        entity, df = ["_all"], df.withColumn("_all", F.lit(1))
    prims, where = {}, {}
    for name, spec in specs.items():
        for part, prim in _parts(spec).items():
            where[(name, part)] = f"_p{len(prims)}"
            prims[where[(name, part)]] = prim
    hot, hot_total = None, 0
    if hot_rows is not None:
        hot = (df if sized_by is None else sized_by).groupBy(*entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        hot_total = hot.agg(F.sum("_n")).first()[0] or 0
    if not hot_total:
        out = df.select("*", *[_local(s, entity, order).alias(n) for n, s in prims.items()])
    else:
        # No more than rows / hot_rows keys, so the list stays broadcastable.
        marks = F.broadcast(hot.select(*[F.col(e).alias(f"_h{i}") for i, e in enumerate(entity)]))
        same = [F.col(e).eqNullSafe(F.col(f"_h{i}")) for i, e in enumerate(entity)]
        big, rest = df.join(marks, same, "left_semi"), df.join(marks, same, "left_anti")
        n_chunks = 2 * -(-hot_total // hot_rows) + 1
        out = _chunked(big, entity, order, prims, n_chunks).unionByName(
            rest.select("*", *[_local(s, entity, order).alias(n) for n, s in prims.items()])
        )
    got = {name: {p: F.col(where[(name, p)]) for p in _parts(spec)} for name, spec in specs.items()}
    return out.select(*columns, *[_finish(spec, got[name]).alias(name) for name, spec in specs.items()])


# -- the single features -------------------------------------------------------------------------

def n_prior_contests() -> Run:
    return Run("count", inclusive=False)


def running_flag_count(flag) -> Run:
    return Run("sum", _c(flag).cast("int"))


def running_count() -> Run:
    return Run("count")


def first_date(date) -> Run:
    return Run("min", date)


def days_since_first(df: DataFrame, entity, date, order, name="days_since_first", **kw) -> DataFrame:
    out = with_running(df, entity, order, {"_first": first_date(date)}, **kw)
    return out.withColumn(name, F.datediff(date, "_first")).drop("_first")


def days_since_prev(df: DataFrame, entity, date, order, name="days_since_prev", **kw) -> DataFrame:
    out = with_running(df, entity, order, {"_prev": Run("lag", date)}, **kw)
    return out.withColumn(name, F.datediff(date, "_prev")).drop("_prev")


def prior_total(c) -> Run:
    return Run("prior_total", c, default=0)


def running_min(c) -> Run:
    return Run("min", c, mask=True)


def running_max(c) -> Run:
    return Run("max", c, mask=True)


def prev_value(c) -> Run:
    return Run("lag", c)


def capped_recency(c, cap=730) -> Column:
    """A cap from above; one later variant of this feature takes the larger value instead, which floors."""
    return F.when(_c(c).isNotNull(), F.least(F.lit(cap), _c(c)))


def ffill(c, default=0) -> Run:
    return Run("last", c, default=default)


def team_running_count(df: DataFrame, team, order, name="n_team", **kw) -> DataFrame:
    return with_running(df, team, order, {name: running_count()}, **kw)


def career_table(df: DataFrame, keys: Keys = Keys(), flag="flag", duration="duration", cls="cls", hot_rows=HOT_ROWS) -> DataFrame:
    """W1-W8 for every (contest, side) of a doubled table.

    The row of a null entity is imputed as a first contest. Duplicate (contest, side) rows are dropped first.
    """
    from .aggs import dedupe_by_key

    base = df.select(keys.contest, keys.side, keys.date, flag, duration, cls)
    known = dedupe_by_key(base.where(F.col(keys.side).isNotNull()), [keys.contest, keys.side], [keys.date])
    ran = with_running(known, keys.side, [keys.date, keys.contest], {
        "n_career": n_prior_contests(),
        "n_flagged": running_flag_count(flag),
        "_first": first_date(keys.date),
        "_prev": Run("lag", keys.date),
        "total_duration": prior_total(duration),
        "min_cls": running_min(cls),
        "max_cls": running_max(cls),
        "prev_cls": prev_value(cls),
    }, hot_rows, sized_by=base.where(F.col(keys.side).isNotNull()))
    features = ran.select(
        keys.contest, keys.side, "n_career", "n_flagged",
        F.datediff(keys.date, "_first").alias("days_since_first"),
        F.datediff(keys.date, "_prev").alias("days_since_prev"),
        "total_duration", "min_cls", "max_cls", "prev_cls",
    )
    types = dict(features.dtypes)
    missing = base.where(F.col(keys.side).isNull()).groupBy(keys.contest, keys.side).agg(F.min(cls).alias("_lo"), F.max(cls).alias("_hi"))
    imputed = missing.select(
        F.col(keys.contest), F.col(keys.side),
        *[F.lit(v).cast(types[n]).alias(n) for n, v in [
            ("n_career", 0), ("n_flagged", 0), ("days_since_first", 0), ("days_since_prev", None), ("total_duration", 0)]],
        F.col("_lo").alias("min_cls"), F.col("_hi").alias("max_cls"), F.lit(None).cast(types["prev_cls"]).alias("prev_cls"),
    )
    return features.unionByName(imputed)


def batch_counters(df: DataFrame, keys: Keys = Keys(), flag=None, hot_rows=HOT_ROWS, sized_by: DataFrame = None) -> DataFrame:
    """Per (entity, date): contest days strictly before the date, all and flagged; a day counts once."""
    marked = df.select(F.col(keys.side).alias("entity"), F.col(keys.date),
                       (F.lit(0) if flag is None else F.coalesce(_c(flag).cast("int"), F.lit(0))).alias("_f"))
    days = marked.groupBy("entity", keys.date).agg(F.max("_f").alias("_f"))
    return with_running(days, "entity", keys.date, {
        "n_before": Run("count", inclusive=False, default=0),
        "n_flagged_before": Run("sum", "_f", inclusive=False, default=0),
    }, hot_rows, sized_by).drop("_f")


def position_in_block(df: DataFrame, group, order, size, hot_rows=HOT_ROWS) -> DataFrame:
    """Consecutive rows of a page form blocks of `size`: adds the block number and the place inside it."""
    out = with_running(df, group, order, {"_i": Run("count", inclusive=False, default=0)}, hot_rows)
    return out.withColumn("block", F.expr(f"_i div {int(size)}")).withColumn("place", F.col("_i") % size).drop("_i")


def segment_attribution(df: DataFrame, group, order, is_header, n_children, name, hot_rows=HOT_ROWS) -> DataFrame:
    """A pair of header rows announces 2 * n rows that belong to it; rows behind those are event-level.

    Adds block, role, side_name, opp_name and `violation` (the two headers of a pair disagree on n).
    """
    order = [order] if isinstance(order, str) else list(order)
    head = F.coalesce(_c(is_header), F.lit(False))
    counted = with_running(df, group, order, {
        "_row": Run("count"), "_heads": Run("sum", head.cast("int")),
    }, hot_rows)
    first, second = head & (F.col("_heads") % 2 == 1), head & (F.col("_heads") % 2 == 0)
    filled = with_running(counted, group, order, {
        "_n0": Run("last", F.when(first, F.coalesce(_c(n_children), F.lit(0)))),
        "_n1": Run("last", F.when(second, F.coalesce(_c(n_children), F.lit(0)))),
        "_s": Run("last", F.when(first, _c(name))),
        "_o": Run("last", F.when(second, _c(name))),
        "_start": Run("last", F.when(second, F.col("_row"))),
    }, hot_rows)
    child = ~head & (F.col("_row") - F.col("_start") <= 2 * F.col("_n1"))
    role = F.when(first, "side").when(second, "opp").when(child, "child").otherwise("event")
    return filled.select(
        *df.columns,
        F.expr("(_heads + 1) div 2").alias("block"), role.alias("role"),
        F.when(child, F.col("_s")).alias("side_name"), F.when(child, F.col("_o")).alias("opp_name"),
        (~first & (F.col("_n0") != F.col("_n1"))).alias("violation"),
    ).withColumn("violation", F.coalesce("violation", F.lit(False)))


def card_rank(df: DataFrame, event, order, name="card_rank", hot_rows=HOT_ROWS) -> DataFrame:
    return with_running(df, event, order, {name: Run("count")}, hot_rows)
