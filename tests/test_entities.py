"""Identity resolution recovers a generated relabelling, tolerates shifted dates and reports conflicts."""

import datetime as dt
import random

import pytest

from duelframe.operators import entities as E
from duelframe.operators.checks import CheckFailed

SCHEMA = "d date, side string, opp string, side_name string, opp_name string"


def world(n=30, seed=5):
    """Sparse contests on distinct days; every third entity has another name in the second source."""
    rng = random.Random(seed)
    canon, aux = [], []
    for i in range(150):
        a, b = rng.sample(range(n), 2)
        d = dt.date(2020, 1, 1) + dt.timedelta(days=4 * i)
        canon.append((d, f"c{a}", f"c{b}", f"name {a}", f"name {b}"))
        name = lambda x: f" Name {x}" if x % 3 else f"other {x}"
        ident = lambda x: f"b{x}" if x == 7 and i % 2 else f"a{x * 7919 % 100003}"
        shift = dt.timedelta(days=1 if i % 10 == 0 else 0)
        aux.append((d + shift, ident(a), ident(b), name(a), name(b)))
    truth = {}
    for c, x in zip(canon, aux):
        truth[x[1]], truth[x[2]] = c[1], c[2]
    return canon, aux, truth


def test_relabelling_is_recovered(spark):
    canon, aux, truth = world()
    result = E.resolve_entities(spark.createDataFrame(canon, SCHEMA), spark.createDataFrame(aux, SCHEMA), tol_days=1)
    assert {r.aux_id: r.canon_id for r in result.id_map.collect()} == truth
    assert result.strays.isEmpty() and result.conflicts.isEmpty()


def test_contest_map_brings_every_contest(spark):
    canon, aux, truth = world()
    both = lambda rows: rows + [(d, o, s, on, sn) for d, s, o, sn, on in rows]
    got = E.contest_map(spark.createDataFrame(both(aux), SCHEMA), spark.createDataFrame(both(canon), SCHEMA), id_tol=1, join_tol=1)
    rows = got.collect()
    assert len(rows) == 300
    assert all(truth[r.side_aux] == r.side_canon and abs((r.d_aux - r.d_canon).days) <= 1 for r in rows)


def test_merged_canonical_ids_are_split_again(spark):
    d = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=5 * i)
    canon = [(d(0), "c1", "c9", "joe", "max"), (d(1), "c2", "c8", "joe", "sam"), (d(2), "c9", "c8", "max", "sam")]
    aux = [(x, {"c1": "a1", "c2": "a1"}.get(s, s + "x"), o + "x", sn, on) for x, s, o, sn, on in canon]
    merge = spark.createDataFrame([("c2", "c1")], "f string, t string")
    got = E.contest_map(spark.createDataFrame(aux, SCHEMA), spark.createDataFrame(canon, SCHEMA), merge_canon=merge)
    assert sorted((r.side_aux, r.side_canon) for r in got.collect()) == [("a1", "c1"), ("a1", "c2"), ("c9x", "c9")]


def test_conflict_raises_or_is_returned(spark):
    canon, aux, _ = world()
    bad = canon + [(dt.date(2030, 1, 1), "c1", "c2", "twin", "name 4")]
    twin = aux + [(dt.date(2030, 1, 1), "a" + str(8 * 7919 % 100003), "a" + str(4 * 7919 % 100003), "twin", "name 4")]
    args = spark.createDataFrame(bad, SCHEMA), spark.createDataFrame(twin, SCHEMA)
    with pytest.raises(CheckFailed):
        E.resolve_entities(*args, tol_days=1)
    result = E.resolve_entities(*args, tol_days=1, on_conflict="return")
    assert not result.conflicts.isEmpty()


def test_manual_entries_win(spark):
    old = spark.createDataFrame([("a", "c1")], E.MAP_SCHEMA)
    cand = spark.createDataFrame([("a", "c2"), ("b", "c3"), ("e", "c4"), ("e", "c5")], E.MAP_SCHEMA)
    id_map, conflicts = E.update_map(old, cand)
    assert {r.aux_id: r.canon_id for r in id_map.collect()} == {"a": "c1", "b": "c3"}
    assert sorted((r.aux_id, r.kind) for r in conflicts.collect()) == [("a", "known"), ("e", "several"), ("e", "several")]


def test_reachable_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "s string, t string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in E.reachable_ids(edges, roots, 10).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    failed = spark.createDataFrame([("c",)], "id string")
    assert {r.id for r in E.reachable_ids(edges, roots, 10, failed).collect()} == {"a", "b", "c"}


def test_presets_reject_unknown_options():
    with pytest.raises(ValueError):
        E.split_key_pairs({"x": {"tolerance": 1}})


def chain(n):
    """Only the first contest's names agree; every further id follows from the one before."""
    d = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=3 * i)
    canon = [(d(i), f"c{i}", f"c{i + 1}", f"name {i}", f"name {i + 1}") for i in range(n)]
    aux = [(x, s.replace("c", "a"), o.replace("c", "a"), sn if i == 0 else f"x{i}", on if i == 0 else f"y{i}")
           for i, (x, s, o, sn, on) in enumerate(canon)]
    return canon, aux


def test_long_chain_is_resolved_to_its_end(spark):
    canon, aux = [spark.createDataFrame(rows, SCHEMA) for rows in chain(44)]
    result = E.resolve_entities(canon, aux)
    assert result.complete and {r.aux_id: r.canon_id for r in result.id_map.collect()} == {f"a{i}": f"c{i}" for i in range(45)}


def test_a_hit_bound_is_told(spark):
    canon, aux = [spark.createDataFrame(rows, SCHEMA) for rows in chain(9)]
    result = E.resolve_entities(canon, aux, max_iters=2)
    assert not result.complete and result.id_map.count() < 10
    with pytest.raises(CheckFailed):
        E.contest_map(aux, canon, max_iters=2)
    edges = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(5)], "s string, t string")
    roots = spark.createDataFrame([("0",)], "id string")
    assert E.reachable_ids(edges, roots).count() == 6 and E.reachable_ids(edges, roots, 5).count() == 6
    with pytest.raises(CheckFailed):
        E.reachable_ids(edges, roots, 4)


def test_every_candidate_of_a_conflict_is_listed_once(spark):
    d = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=3 * i)
    canon = [(d(i), f"c{i}", f"o{i}", "joe", f"max {i}") for i in range(3)]
    aux = [(d(i), "a", f"p{i}", "joe", f"max {i}") for i in range(3)]
    result = E.resolve_entities(spark.createDataFrame(canon, SCHEMA), spark.createDataFrame(aux, SCHEMA), on_conflict="return")
    assert sorted(map(tuple, result.conflicts.collect())) == [("a", f"c{i}", "several") for i in range(3)]


def test_blank_names_agree_with_nothing(spark):
    day = dt.date(2020, 1, 1)
    canon = [(day, f"c{i}", f"o{i}", "", None) for i in range(3)]
    aux = [(day, f"a{i}", f"p{i}", None, " ") for i in range(4)]
    edges = [E.contest_edges(spark.createDataFrame(rows, SCHEMA)) for rows in (canon, aux)]
    assert E.seed_map(*edges).isEmpty()


def test_snapshots_a_day_off(spark):
    """A snapshot on the day before or after is mapped to its contest, with its own date kept; two days off, to none."""
    day = lambda n: dt.date(2020, 1, n)
    rows = "d date, side string, opp string, side_name string, opp_name string"
    both = lambda d, a, b: [(d, a, b, f"n{a[1:]}", f"n{b[1:]}"), (d, b, a, f"n{b[1:]}", f"n{a[1:]}")]
    canon = spark.createDataFrame(both(day(10), "c1", "c2") + both(day(20), "c1", "c3") + both(day(25), "c2", "c3"), rows)
    snaps = spark.createDataFrame(both(day(9), "s1", "s2") + both(day(21), "s1", "s3") + both(day(27), "s2", "s3") + both(day(20), "s1", "s3") + [(None, "s1", "s2", "n1", "n2")], rows)
    found = E.snapshot_map(snaps, canon, suffixes=("_snap", "_canon"))
    got = {(r.side_snap, r.opp_snap, r.d_snap.day, r.d_snap_orig.day, r.side_canon, r.opp_canon, r.d_canon.day) for r in found.collect()}
    ways = lambda a, b, d, own: {(f"s{x}", f"s{y}", d, own, f"c{x}", f"c{y}", d) for x, y in ((a, b), (b, a))}
    assert got == ways(1, 2, 10, 9) | ways(1, 3, 20, 21) | ways(1, 3, 20, 20)


def test_contest_map_reads_its_inputs_once(spark, tmp_path):
    """Contests are written once; rounds and the last join read them there, whatever it cost to derive them."""
    canon, aux, _ = world(12)
    for name, rows in (("canon", canon), ("aux", aux)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name))
    got = E.contest_map(*[spark.read.parquet(str(tmp_path / name)) for name in ("aux", "canon")], id_tol=1, join_tol=1)
    assert not [f for f in got.inputFiles() if str(tmp_path) in f]
    assert got.count()


def test_tolerance_offers_few_rows_twice(spark):
    """Every pair within the tolerance is found once, and rows are offered to hardly more stretches than their own."""
    from duelframe.operators.joins import offered_stretches, tolerant_date_join
    days = [dt.date(1969, 12, 1) + dt.timedelta(days=i) for i in range(64)]
    left = spark.createDataFrame([("k", d) for d in days], "a string, l date")
    right = spark.createDataFrame([("k", d) for d in days], "b string, r date")
    for tol in (0, 1, 3):
        got = sorted((x.l, x.r) for x in tolerant_date_join(left, right, [("a", "b")], "l", "r", tol).collect())
        assert got == sorted((x, y) for x in days for y in days if abs((x - y).days) <= tol)
    offers = right.selectExpr("r").withColumn("s", offered_stretches(right.r, 1)).selectExpr("sum(size(s))").first()[0]
    assert offers <= 1.3 * len(days)
