"""What is written, moved and kept on the way to a result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duelframe.keys import Keys
from duelframe.operators import entities as E, ratings as R
from duelframe.plans import load_all
from duelframe.session import SHUFFLE_CLEANUP, discard, materialize

K, QUERIES = Keys(), load_all()[0]
SCHEMA = "d date, side string, opp string, side_name string, opp_name string"
RATED = "contest string, side string, opp string, d date, y double, l double, t double"


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_writes_leave_no_shuffle_files(spark):
    """they stayed until the driver happened to collect its garbage."""
    was, before = spark.conf.get(SHUFFLE_CLEANUP, None), shuffled(spark)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = materialize(df, "kept")
    assert not shuffled(spark) - before and spark.conf.get(SHUFFLE_CLEANUP, None) == was
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect())) and df.count() == df.count() == 7
    discard(table, df, None)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
    assert not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)


def world(n=12, days=60):
    rng, canon, aux = random.Random(3), [], []
    for i in range(days):
        a, b = rng.sample(range(n), 2)
        d = dt.date(2020, 1, 1) + dt.timedelta(days=4 * i)
        name = lambda x: f"name {x}" if x % 3 else f"other {x}"
        for x, y in ((a, b), (b, a)):
            canon.append((d, f"c{x}", f"c{y}", f"name {x}", f"name {y}"))
            aux.append((d + dt.timedelta(days=i % 10 == 0), f"a{x}", f"a{y}", name(x), name(y)))
    return canon, aux


@pytest.mark.parametrize("merged", [False, True])
def test_contest_map_keeps_what_its_result_reads(spark, monkeypatch, merged):
    """contests, edges, rounds and targets were all kept to the end."""
    written, kept, targets = [], E.materialize, E.bucketed
    monkeypatch.setattr(E, "materialize", lambda df, label, *a: written.append((label, kept(df, label, *a))) or written[-1][1])
    monkeypatch.setattr(E, "bucketed", lambda df, by, label: written.append((label, targets(df, by, label))) or written[-1][1])
    canon, aux = world()
    merge = spark.createDataFrame([("nobody", "c1")], "f string, t string") if merged else None
    found = E.contest_map(spark.createDataFrame(aux, SCHEMA), spark.createDataFrame(canon, SCHEMA), merge_canon=merge, id_tol=1, join_tol=1)
    there = [label for label, t in written if (p := spark._jvm.org.apache.hadoop.fs.Path(t._written_at)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    assert {"round", "targets", "canon", "aux"} <= {label for label, _ in written}
    assert set(there) <= {"known", "contests", "candidates"} and there.count("contests") == 1
    rows = found.collect()
    assert found.columns == ["side_aux", "opp_aux", "d_aux", "side_canon", "opp_canon", "d_canon"]
    assert len(rows) == len(aux) and all(r.side_aux[1:] == r.side_canon[1:] and r.opp_aux[1:] == r.opp_canon[1:] for r in rows)


def test_snapshots_are_not_spread_to_find_their_dates(spark, monkeypatch):
    """the result joined its contests with three rows a snapshot, and every table of the map was kept for it."""
    written, kept = [], E.materialize
    monkeypatch.setattr(E, "materialize", lambda df, label, *a: written.append((label, kept(df, label, *a))) or written[-1][1])
    canon, aux = world()
    rows = spark.createDataFrame(aux + aux[:4], SCHEMA)
    found = E.snapshot_map(rows, spark.createDataFrame(canon, SCHEMA), suffixes=("_s", "_c"))
    there = {label for label, t in written if (p := spark._jvm.org.apache.hadoop.fs.Path(t._written_at)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)}
    assert there <= {"snapshots", "mapped", "candidates"}
    snapshots = next(t for label, t in written if label == "snapshots")
    assert snapshots.count() == len(aux)
    got = found.collect()
    assert found.columns == ["side_s", "opp_s", "d_s", "side_c", "opp_c", "d_c", "d_s_orig"]
    assert len(got) == len(aux) and all(r.d_s == r.d_c and abs((r.d_s_orig - r.d_s).days) <= 1 and r.side_s[1:] == r.side_c[1:] for r in got)


def test_edges_are_written_in_one_orientation(spark):
    """a contest was written twice, with a key that nothing read."""
    canon, _ = world()
    df = spark.createDataFrame(canon, SCHEMA)
    edges, one = E.written_edges(df, "edges")
    want = E.contest_edges(df).drop("contest")
    assert sorted(map(tuple, edges.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert 2 * one.count() == edges.count() and "contest" not in one.columns


def contests(n=60, groups=6):
    rng, rows = random.Random(5), []
    for i in range(n):
        g = i % groups
        a, b = rng.sample([f"g{g}-{x}" for x in "abc"], 2)
        d, y = dt.date(2020, 1, 1) + dt.timedelta(days=i // 6), rng.gauss(0, 1)
        rows += [(f"k{i}", a, b, d, y, float(i % 5), 9.0), (f"k{i}", b, a, d, -y, float(i % 4), 9.0 if i % 7 else None)]
    return rows


def test_a_cell_of_a_grid_moves_alone(spark):
    """all 64 ratings of both sides, before and after, went through two shuffles of the contest rows."""
    df = spark.createDataFrame(contests(), RATED)
    steps = [k / 100 for k in range(1, 65)]
    wide = R.rating_multi(df, K, {"y": steps}, "real")
    one = wide.select("contest", "side", F.col("`pred_y@0.32`").alias("p"))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "_side_before_31" in plan and "_opp_before_31" in plan
    assert "_side_before_30" not in plan and "_side_after" not in plan and "_opp_after" not in plan
    want = {(r.contest, r.side): r.pred for r in R.rating_real(df, K, ["y"], 0.32).features.collect()}
    got = {(r.contest, r.side): r.p for r in one.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_small_components_need_no_order_and_one_window(spark, monkeypatch):
    """All contests were sorted and written a second time, and walked in several windows."""
    df = spark.createDataFrame(contests(120), RATED)
    want = {(r.contest, r.side): r.pred for r in R.rating_real(df, K, ["y"], 0.4).features.collect()}
    monkeypatch.setattr(R, "WINDOW_VALUES", 40)  # six components of 40 rows among 240
    labels, kept = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label, *a: labels.append(label) or kept(df, label, *a))
    result = R.rating_real(df, K, ["y"], 0.4)
    assert result.windows == 1 and "sorted" not in labels
    got = {(r.contest, r.side): r.pred for r in result.features.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ends_are_not_written_beside_the_keys(spark, monkeypatch):
    """entities were written and moved twice, as key and as end; numbers as keys are ends, too."""
    labels, kept = {}, R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label, *a: labels.setdefault(label, df.columns) and kept(df, label, *a))
    rows = [(f"k{i}", i % 3, (i + 1) % 3, dt.date(2020, 1, 1 + i // 4), float(i)) for i in range(20)]
    result = R.rating_real(spark.createDataFrame(rows, "contest string, side long, opp long, d date, y double"), K, ["y"], 0.4)
    assert {"e_side", "e_opp"}.isdisjoint(labels["contests"])
    assert result.features.count() == 20 and {r.entity for r in result.state.collect()} == {"0", "1", "2"}
    assert result.features.where("side_after = side_before and d = '2020-01-02'").isEmpty()


def test_wide_accuracies_are_the_long_ones(spark):
    """the grid pivoted a row for each contest, side and cell."""
    rows = contests()
    rows += [rows[4], ("twice", "g0-a", "g0-b", rows[4][3], 0.0, 1.0, 2.0), ("twice", "g0-a", "g0-b", dt.date(2020, 1, 9), 0.0, 1.0, 2.0),
             ("lone", "g0-a", "g0-b", rows[4][3], 0.0, 1.0, 2.0), ("self", "g0-a", "g0-a", rows[4][3], 0.0, 1.0, 2.0), (None, "g0-a", None, rows[4][3], 0.0, 1.0, 2.0)]
    df, steps = spark.createDataFrame(rows, RATED), [0.05, 0.1, 0.2]
    result = R.rating_accuracy(df, K, {"q": ("l", "t")}, steps)
    long = R.accuracy_features(result, K).groupBy("contest", "side", "opp").agg(*[F.max(F.when(F.col("cell") == f"q@{x}", F.col(c))).alias(f"{c}_{k}") for k, x in enumerate(steps) for c in ("p_diff", "logit_diff")])
    wide = R.accuracy_features_wide(result, steps, K)
    assert wide.columns == long.columns
    plain = lambda df: sorted((str(r[:3]), *[None if v is None else round(v, 12) for v in r[3:]]) for r in df.collect())
    assert [r[0] for r in plain(wide)] == [r[0] for r in plain(long)] and plain(wide) == plain(long)


def test_rating_regression_reads_written_contests(spark, sf):
    """the contests were derived three times, for the ratings and for both sides of the fit."""
    files = QUERIES["R14_rating_logit"](spark, sf).inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_accuracies_and_trees_read_written_contests(spark, sf):
    """The contests were derived for the pooled rate and the quantiles, and again for the rows."""
    for name in ("R4_rating_accuracy", "R9_accuracy_features", "R16_boosted_trees"):
        files = QUERIES[name](spark, sf).inputFiles()
        assert files and not any("lineitem" in f for f in files)


def test_careers_meet_contests_where_they_lie(spark, sf):
    """contests and careers moved twice each; missing entities still meet their careers."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = QUERIES["W9_career_table"](spark, sf)
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert out.where("side is null").count() and out.where("n_career is null or n_career_opp is null").isEmpty()


def test_components_write_only_what_they_rate(spark, monkeypatch):
    """all columns of the contests were written for their deviations."""
    from duelframe.operators import aggs
    written, kept = {}, aggs.materialize
    monkeypatch.setattr(aggs, "materialize", lambda df, label, *a: written.setdefault(label, df.columns) and kept(df, label, *a))
    df = spark.createDataFrame(contests(), RATED).withColumns({"g": F.col("t"), "more": F.lit("x")})
    assert R.pca_rating(df, K, ["y", "l"], 1, 0.1, "g").features.count() == 120
    assert not {"more", "t"} & set(written["grouped"]) and "g" in written["grouped"]


def test_sources_are_joined_one_after_the_other(spark):
    """what all sources moved stayed until the last was joined."""
    from duelframe.operators.joins import three_source_join
    day = dt.date(2020, 1, 1)
    canon = spark.createDataFrame([("a", "b", day), ("b", "a", day), ("c", "d", day)], "side string, opp string, d date")
    source = lambda n: (spark.createDataFrame([(f"a{n}", f"b{n}", day, n)], f"side string, opp string, d date, v{n} int"),
                        spark.createDataFrame([("a", "b", day, f"a{n}", f"b{n}", day)], f"side string, opp string, d date, side_{n} string, opp_{n} string, d_{n} date"), f"_{n}")
    out = three_source_join(canon, (source(n) for n in range(3)))
    assert any("/joined-" in f for f in out.inputFiles()) and out.count() == 3
    assert [tuple(r) for r in out.where("side = 'a'").select("v0_0", "v1_1", "v2_2", "is_upcoming").collect()] == [(0, 1, 2, False)]


def test_sources_of_the_assembly_are_written(spark, monkeypatch):
    """one statement moved both sources, their maps and the canon."""
    from duelframe.operators import joins
    written, kept = {}, joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, label, *a: written.setdefault(label, kept(df, label, *a)))
    day = dt.date(2020, 1, 1)
    base, ids = "side string, opp string, d date", lambda s: f"side_{s} string, opp_{s} string, d_{s} date"
    canon = spark.createDataFrame([("a", "b", day), ("b", "a", day)], base)
    source = spark.createDataFrame([("x", "y", day, 1)], base + ", v int")
    link = lambda s: spark.createDataFrame([("x", "y", day, "a", "b", day)], f"{ids(s)}, {base}")
    table, counts = joins.assemble(canon, source, link("stats"), source, link("prices"))
    assert sorted((r.side, r.v_stats, r.v_prices) for r in table.collect()) == [("a", 1, 1), ("b", None, None)] and counts["statistics"] == 2
    there = lambda t: (p := spark._jvm.org.apache.hadoop.fs.Path(t._written_at)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    assert [label for label in ("statistics", "prices", "assembled") if there(written[label])] == ["assembled"]


def test_histograms_of_all_nodes_are_those_of_each(spark):
    """F8: every open node read all rows once more."""
    import numpy as np
    import pyarrow as pa
    from duelframe.operators.boosting import _histograms, apply_tree
    rng = np.random.default_rng(3)
    bins, y, margin, held = rng.integers(0, 5, (400, 2)), rng.integers(0, 2, 400).astype(float), rng.normal(size=400), rng.random(400) < 0.2
    tree = {0: (0, 2), 1: (1, 1), 2: 0.25, 4: -0.5}
    node, value = apply_tree(tree, bins)
    for row, at, v in zip(bins, node, value):
        k = 0
        while isinstance(tree.get(k), tuple):
            f, cut = tree[k]
            k = 2 * k + 1 + int(row[f] > cut)
        assert (at, v) == (k, tree.get(k, 0.0))
    batch = pa.RecordBatch.from_arrays([pa.array(bins.astype(float).tolist()), pa.array(y), pa.array(margin), pa.array(held)], names=["bins", "y", "base", "held"])
    growing, open_ = {0: (0, 2), 2: (1, 0)}, [1, 5, 6]
    got = _histograms([], growing, open_, 0.1, 2, 7)(batch)[0][:-2].reshape(3, 2, 7, 2)
    p, at = 1 / (1 + np.exp(-margin)), apply_tree(growing, bins)[0]
    for i, k in enumerate(open_):
        for f in range(2):
            own = ~held & (at == k)
            assert np.array_equal(got[i, f, :, 0], np.bincount(bins[own, f], (p - y)[own], 7)) and np.array_equal(got[i, f, :, 1], np.bincount(bins[own, f], (p * (1 - p))[own], 7))
