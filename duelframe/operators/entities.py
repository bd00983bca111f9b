"""Entity resolution across two contest tables that share no key.

Both tables hold contests with side, opp, date, side_name, opp_name. Ids of the auxiliary table are learned
from contests whose names agree and then along contests against already known opponents.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import _c
from ..keys import Keys
from ..session import BROADCAST_ROWS, bucketed, discard, materialize
from .aggs import dedupe_by_key
from .checks import CheckFailed
from .joins import _within, offered_stretches, stretch, tolerant_date_join
from .rows import both_orientations, overwrite_values

MAP_SCHEMA = "aux_id string, canon_id string"


def contest_key(a, b, d) -> Column:
    a, b = F.coalesce(_c(a), F.lit("unknown")), F.coalesce(_c(b), F.lit("unknown"))
    return F.concat_ws("_", _c(d).cast("date").cast("string"), F.least(a, b), F.greatest(a, b))


def clean_names(df: DataFrame, cols, replacements_df: DataFrame = None) -> DataFrame:
    df = df.withColumns({c: F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in cols})
    if replacements_df is None:
        return df
    return overwrite_values(df, cols, replacements_df, "_raw").drop(*[c + "_raw" for c in cols])


def contest_edges(df: DataFrame, keys: Keys = Keys(), replacements_df: DataFrame = None) -> DataFrame:
    """Doubled, cleaned contests with ids and date present; one contest per key."""
    return _both_ways(_one_way(df, keys, replacements_df), keys)


def _one_way(df, keys, replacements_df):
    cols = [keys.side, keys.opp, keys.date, "side_name", "opp_name"]
    base = df.select(*cols).na.drop(how="any", subset=cols[:3])
    one = dedupe_by_key(base.withColumn("contest", contest_key(keys.side, keys.opp, keys.date)), ["contest"], cols[:2])
    return clean_names(one, ["side_name", "opp_name"], replacements_df)


def _both_ways(one, keys):
    return both_orientations(one, {keys.side: keys.opp, "side_name": "opp_name"})


def written_edges(df: DataFrame, label, keys: Keys = Keys(), replacements_df: DataFrame = None) -> tuple:
    """(contest edges without their key, the table they are read from): a contest is written once, in one orientation, and
    doubled whenever it is read."""
    one = materialize(_one_way(df, keys, replacements_df).drop("contest"), label)
    return _both_ways(one, keys), one


def _canon_side(canon, keys):
    return canon.select(
        F.col(keys.side).alias("c_side"), F.col(keys.opp).alias("c_opp"), F.col(keys.date).alias("c_d"),
        F.col("side_name").alias("c_side_name"), F.col("opp_name").alias("c_opp_name"))


def seed_map(canon: DataFrame, aux: DataFrame, tol_days=0, keys: Keys = Keys()) -> DataFrame:
    """Candidate (aux_id, canon_id) pairs from contests whose two names agree; a blank name agrees with nothing."""
    return _seed_hits(canon, aux, tol_days, keys).distinct()


def _seed_hits(canon, aux, tol_days, keys):
    named = (F.col("side_name") != "") & (F.col("opp_name") != "")
    canon, aux = canon.where(named), aux.where(named)
    hits = tolerant_date_join(aux, _canon_side(canon, keys), [("side_name", "c_side_name"), ("opp_name", "c_opp_name")],
                              keys.date, "c_d", tol_days)
    return hits.select(F.col(keys.side).alias("aux_id"), F.col("c_side").alias("canon_id"))


def drop_same_day_multi(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Drop contests of an entity with several opponents that day: by side, then by opponent on the rest.

    Each pass moves the rows once: a window tells the day's opponents beside the row."""
    for entity, other in ((keys.side, keys.opp), (keys.opp, keys.side)):
        day = Window.partitionBy(entity, keys.date)
        several = (F.min(other).over(day) != F.max(other).over(day)) & F.col(entity).isNotNull() & F.col(keys.date).isNotNull()
        df = df.withColumn("_several", F.coalesce(several, F.lit(False))).where("not _several").drop("_several")
    return df


def frontier(aux: DataFrame, canon: DataFrame, id_map: DataFrame, tol_days=0, keys: Keys = Keys(), known: DataFrame = None) -> DataFrame:
    """Candidates from contests with an unknown side and a known opponent.

    `known` is the full map where `id_map` holds only its newest part.
    """
    all_known = (id_map if known is None else known).select(F.col("aux_id").alias("_known"))
    opp_map = id_map.select(F.col("aux_id").alias("_o"), F.col("canon_id").alias("_oc"))
    open_rows = (
        aux.join(opp_map, F.col(keys.opp) == F.col("_o"), "inner")
        .join(all_known, F.col(keys.side) == F.col("_known"), "left_anti")
    )
    hits = tolerant_date_join(open_rows, _canon_side(canon, keys), [("_oc", "c_opp")], keys.date, "c_d", tol_days)
    return hits.select(F.col(keys.side).alias("aux_id"), F.col("c_side").alias("canon_id")).distinct()


def update_map(id_map: DataFrame, candidates: DataFrame) -> tuple:
    """(map with the new entries, conflicts). Entries already known win; every disagreement is reported."""
    new, conflicts = _split(id_map, candidates)
    return id_map.unionByName(new), conflicts


def _split(id_map, candidates):
    pairs = candidates.select("aux_id", "canon_id").distinct()
    grouped = pairs.groupBy("aux_id").agg(F.min("canon_id").alias("canon_id"), F.max("canon_id").alias("_hi"))
    clash = grouped.where(F.col("canon_id") != F.col("_hi")).select("aux_id")
    old = id_map.select(F.col("aux_id").alias("_a"), F.col("canon_id").alias("_c"))
    inner = pairs.join(clash, "aux_id", "left_semi").select("aux_id", "canon_id", F.lit("several").alias("kind"))
    against = pairs.join(old, (F.col("aux_id") == F.col("_a")) & (F.col("canon_id") != F.col("_c"))).select(
        "aux_id", "canon_id", F.lit("known").alias("kind"))
    new = grouped.where(F.col("canon_id") == F.col("_hi")).select("aux_id", "canon_id").join(
        old, F.col("aux_id") == F.col("_a"), "left_anti")
    return new, inner.unionByName(against)


@dataclass
class ResolveResult:
    id_map: DataFrame
    strays: DataFrame
    conflicts: DataFrame
    iters: int
    sizes: list = field(default_factory=list)
    complete: bool = True  # False if `max_iters` stopped a phase that still found ids
    contests: DataFrame = None  # the written table that `strays` reads; who needs none may discard it


def _small(df, n):
    """Broadcast only what was counted."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def resolve_entities(canon: DataFrame, aux: DataFrame, manual: DataFrame = None, tol_days=0, max_iters=None,
                     include_multi=True, keys: Keys = Keys(), replacements_df: DataFrame = None,
                     on_conflict="raise") -> ResolveResult:
    """Learn aux_id -> canon_id. Several aux ids may share one canonical id, never the other way round.

    Each round only follows contests against ids found in the round before: a contest whose opponent was known
    earlier and found no partner then finds none later either. So a contest leaves the table once one of its ids is known,
    and the canonical contests, in buckets of opponent and stretch of days, are not moved by a round. Rounds go on until
    one finds nothing; `max_iters` stops a phase earlier and marks the result as not complete. Every disagreement is
    reported once, with all its candidates.
    """
    spark = canon.sparkSession
    canon_all, canon_one = written_edges(canon, "canon", keys, replacements_df)
    aux_all, aux_one = written_edges(aux, "aux", keys, replacements_df)
    old = None if manual is None else materialize(manual.toDF("aux_id", "canon_id"), "manual")
    conflicts = spark.createDataFrame([], MAP_SCHEMA + ", kind string")
    rounds, sizes, state, complete = 0, [], {"map": old, "conflicts": conflicts}, True

    def report(bad):
        bad = materialize(bad.select("aux_id", "canon_id", "kind").distinct(), "conflicts")
        state["conflicts"] = state["conflicts"].unionByName(bad)
        if on_conflict == "raise" and (some := bad.limit(20).collect()):
            raise CheckFailed(f"ids map to more than one canonical id: {some}")

    def learn(hits, old=None):
        """One written table per round: each id with the least and the greatest of its candidates. `old` has the entries that
        the hits may hold already; hits of a round have none."""
        if old is not None:
            report(hits.join(old.toDF("_a", "_c"), (F.col("aux_id") == F.col("_a")) & (F.col("canon_id") != F.col("_c"))).withColumn("kind", F.lit("known")))
            hits = hits.join(old.select(F.col("aux_id").alias("_a")), F.col("aux_id") == F.col("_a"), "left_anti")
        told = materialize(hits.groupBy("aux_id").agg(F.min("canon_id").alias("canon_id"), F.max("canon_id").alias("_hi")), "candidates")
        one = F.col("canon_id") == F.col("_hi")
        n_new, n_bad = told.agg(F.count_if(one), F.count_if(~one)).first()
        if n_bad:
            report(hits.join(told.where(~one).select("aux_id"), "aux_id", "left_semi").withColumn("kind", F.lit("several")))
        new = told.where(one).select("aux_id", "canon_id")
        state["map"] = new if state["map"] is None else state["map"].unionByName(new)
        sizes.append(n_new)
        return new, n_new

    learn(_seed_hits(canon_all, aux_all, tol_days, keys), old)
    n_known = sizes[0] + (old.count() if old is not None else 0)
    ids = [keys.side, keys.opp, keys.date]
    phases = [lambda df: drop_same_day_multi(df, keys)]
    if include_multi:
        phases.append(lambda df: df)
    for phase in phases:
        last, n_last = state["map"], n_known
        open_ids = aux_all.select(keys.side).join(last, F.col(keys.side) == F.col("aux_id"), "left_anti")
        if open_ids.isEmpty():
            break
        rest, targets = phase(aux_all.select(*ids)), _by_opponent(phase(canon_all.select(*ids)), tol_days, keys)
        done, step = 0, None
        while n_last:
            if done == max_iters:
                complete = False
                break
            done, rounds = done + 1, rounds + 1
            before, step = step, materialize(_met(rest, _small(last, n_last), keys), "round")
            discard(before)
            rest = step.where("_oc is null").drop("_oc")
            last, n_last = learn(_partners(step.where("_oc is not null"), targets, tol_days, keys))
            n_known += n_last
        discard(step, targets)
    discard(canon_one)
    final, key = state["map"], contest_key(keys.side, keys.opp, keys.date)
    strays = stray_contests(aux_all, final, keys).withColumn("contest", key)
    return ResolveResult(final, strays, state["conflicts"].distinct(), rounds, sizes, complete, aux_one)


def _met(rest, last, keys):
    """Contests whose side is not among the newest ids, with the canonical id of an opponent that is (`_oc`)."""
    rest = rest.join(last.select(F.col("aux_id").alias("_known")), F.col(keys.side) == F.col("_known"), "left_anti")
    return rest.join(last.toDF("_o", "_oc"), F.col(keys.opp) == F.col("_o"), "left").drop("_o")


def _cell(opp, at) -> Column:
    return F.xxhash64(opp, at)


def _by_opponent(canon, tol_days, keys):
    """Canonical contests in buckets of (opponent, stretch of days): the rounds bring their contests to them."""
    rows = canon.select(F.col(keys.side).alias("c_side"), F.col(keys.opp).alias("c_opp"), F.col(keys.date).alias("c_d"))
    return bucketed(rows.withColumn("_cell", _cell("c_opp", stretch(F.col("c_d"), tol_days))), "_cell", "targets")


def _partners(step, targets, tol_days, keys):
    """(aux_id, canon_id) of contests against a known opponent within the tolerance; may repeat."""
    offered = step.withColumn("_at", F.explode(offered_stretches(F.col(keys.date), tol_days)))
    near = F.abs(F.datediff(keys.date, "c_d")) <= tol_days
    hits = offered.withColumn("_mine", _cell("_oc", "_at")).join(targets, (F.col("_mine") == F.col("_cell")) & _within("_oc", "c_opp") & near)
    return hits.select(F.col(keys.side).alias("aux_id"), F.col("c_side").alias("canon_id"))


def stray_contests(aux: DataFrame, id_map: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Contests with neither side mapped."""
    ids = id_map.select("aux_id")
    for col in (keys.side, keys.opp):
        aux = aux.join(ids, F.col(col) == F.col("aux_id"), "left_anti")
    return aux


def contest_map(aux: DataFrame, canon: DataFrame, suffixes=("_aux", "_canon"), merge_canon: DataFrame = None,
                manual: DataFrame = None, id_tol=0, join_tol=0, include_multi=True, max_iters=None,
                keys: Keys = Keys(), check=True) -> DataFrame:
    """Contest-level map (side, opp, date) of aux -> canon.

    Canonical ids that one auxiliary page conflates are merged by `merge_canon` while learning and split after.
    """
    return _mapped(aux, canon, suffixes, merge_canon, manual, id_tol, join_tol, include_multi, max_iters, keys, check)[0]


def _mapped(aux, canon, suffixes=("_aux", "_canon"), merge_canon=None, manual=None, id_tol=0, join_tol=0, include_multi=True,
            max_iters=None, keys=Keys(), check=True) -> tuple:
    """(contest map, the written tables that it reads)."""
    s_aux, s_canon = suffixes
    ids = [keys.side, keys.opp, keys.date]
    canon_in, aux_in = [materialize(df.select(*ids, "side_name", "opp_name").na.drop(how="any", subset=ids), "contests") for df in (canon, aux)]
    merged = canon_in if merge_canon is None else overwrite_values(canon_in, [keys.side, keys.opp], merge_canon)
    resolved = resolve_entities(merged, aux_in, manual, id_tol, max_iters, include_multi, keys)
    if not resolved.complete:
        raise CheckFailed(f"ids were still found after {max_iters} rounds")
    discard(resolved.contests)
    left = aux_in.select(*[F.col(c).alias(c + s_aux) for c in ids])
    for c, found in ((keys.side, "_side"), (keys.opp, "_opp")):  # contests with an unknown id are in no pair
        left = left.join(resolved.id_map.toDF("_a", found), F.col(c + s_aux) == F.col("_a")).drop("_a")
    left = materialize(left, "known")
    discard(aux_in)
    right = merged.select(F.col(keys.side).alias("m_side"), F.col(keys.opp).alias("m_opp"), F.col(keys.date).alias(keys.date + s_canon), *[
        F.col(c + "_pre_overwrite").alias(c + s_canon) for c in (keys.side, keys.opp) if merge_canon is not None])
    pairs = tolerant_date_join(left, right, [("_side", "m_side"), ("_opp", "m_opp")],
                               keys.date + s_aux, keys.date + s_canon, join_tol)
    if merge_canon is None:
        pairs = pairs.withColumns({keys.side + s_canon: F.col("m_side"), keys.opp + s_canon: F.col("m_opp")})
    if check and manual is not None:  # learned ids have one canonical id, as a round puts each out once
        from .checks import functional_dependency, raise_if_any
        raise_if_any(functional_dependency(pairs, [keys.side + s_aux], ["m_side"]), "one aux id, several canonical ids")
    return pairs.select(*[c + s_aux for c in ids], *[c + s_canon for c in ids]), (left, canon_in)


def snapshot_map(snapshots: DataFrame, canon: DataFrame, tol_days=1, suffixes=("_snapshots", "_canon"), keys: Keys = Keys(), **options) -> DataFrame:
    """Contest map of price snapshots, whose start times may fall `tol_days` beside the contest's date.

    Every snapshot is offered on each day around its own; the contest of that very day claims it. The snapshot's own date
    is kept as `<date><suffix>_orig`. A snapshot near two contests of its pair is mapped to both, as in `tolerant_date_join`.
    """
    days = F.sequence(F.date_sub(keys.date, tol_days), F.date_add(keys.date, tol_days))
    cols = [keys.side, keys.opp, keys.date]
    # Equal snapshots are one before they are spread: three times as many rows would move for it after.
    rows = materialize(snapshots.select(*cols, "side_name", "opp_name").na.drop(how="any", subset=cols).distinct(), "snapshots")
    spread = rows.withColumn(keys.date, F.explode(days))
    pairs, read = _mapped(spread, canon, suffixes=suffixes, keys=keys, **options)
    found = materialize(pairs.distinct(), "mapped")
    discard(*read)
    ids, own = [c + suffixes[0] for c in (keys.side, keys.opp, keys.date)], keys.date + suffixes[0] + "_orig"
    dates = rows.select(*cols).distinct().toDF("_s", "_o", own)
    return tolerant_date_join(found, dates, [(ids[0], "_s"), (ids[1], "_o")], ids[2], own, tol_days).drop("_s", "_o")


def split_key_pairs(config: dict) -> dict:
    """Named presets of `contest_map` -> keyword arguments, unknown names refused."""
    allowed = {"suffixes", "merge_canon", "manual", "id_tol", "join_tol", "include_multi", "max_iters", "keys", "check"}
    for name, options in config.items():
        unknown = set(options) - allowed
        if unknown:
            raise ValueError(f"preset {name!r} has unknown options {sorted(unknown)}")
    return config


# Presets of the source pairings: tolerances in days and whether same-day contests take part. Snapshots carry
# start times that may lie a day off; their rows are first spread by `jitter_date_join`'s days, hence tolerance 0.
PRESETS = split_key_pairs({
    "stats_to_history": {"suffixes": ("_stats", "_history"), "id_tol": 1, "join_tol": 1, "include_multi": True},
    "prices_to_stats": {"suffixes": ("_prices", "_stats"), "id_tol": 0, "join_tol": 0, "include_multi": True},
    "prices_to_history": {"suffixes": ("_prices", "_history"), "id_tol": 1, "join_tol": 1, "include_multi": False},
    "snapshots_to_history": {"suffixes": ("_snapshots", "_history"), "id_tol": 0, "join_tol": 0, "include_multi": True},
})


def reachable_ids(edges: DataFrame, roots: DataFrame, max_depth=None, failed: DataFrame = None) -> DataFrame:
    """(id, depth) of everything reached from the roots; ids in `failed` are reached but not expanded.

    Runs until nothing new is found; raises if that takes more than `max_depth` steps.
    """
    links = edges.select(F.col(edges.columns[0]).cast("string").alias("src"), F.col(edges.columns[1]).cast("string").alias("dst"))
    if failed is not None:
        links = links.join(failed.select(F.col(failed.columns[0]).cast("string").alias("src")), "src", "left_anti")
    links = materialize(links.distinct(), "links")
    level = materialize(roots.select(F.col(roots.columns[0]).cast("string").alias("id"), F.lit(0).alias("depth")).distinct(), "level")
    seen, n = level, level.count()
    depth = 0
    while n:
        depth += 1
        step = links.join(_small(level.select(F.col("id").alias("src")), n), "src", "inner").select(F.col("dst").alias("id")).distinct()
        level = materialize(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        n = level.count()
        if n and max_depth is not None and depth > max_depth:
            raise CheckFailed(f"ids lie more than {max_depth} steps from the roots")
        if n:
            seen = seen.unionByName(level)
    return seen
