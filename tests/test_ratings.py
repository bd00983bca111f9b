"""Ratings per date against a plain Python loop."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from duelframe.keys import Keys
from duelframe.operators import ratings as R

K = Keys()
SCHEMA = "contest string, side string, opp string, d date, y double, win double, offset double, l double, t double"


def table(n=36, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = rng.sample("abcdefg", 2)
        d = dt.date(2020, 1, 1) + dt.timedelta(days=i // 6)
        y, win, off = rng.gauss(0, 1), float(rng.random() < 0.5), rng.gauss(0, 0.5)
        if i % 11 == 0:
            y = win = None
        neg = lambda v: None if v is None else -v
        t1, t2 = rng.randint(1, 30), rng.randint(1, 30)
        rows.append((f"k{i}", a, b, d, y, win, off, float(t1 // 2), float(t1)))
        rows.append((f"k{i}", b, a, d, neg(y), None if win is None else 1 - win, -off, float(t2 // 3) if i % 7 else None, float(t2) if i % 7 else None))
    return rows


def loop(rows, pick, predict, alpha):
    power, out = {}, {}
    for d in sorted({r[3] for r in rows}):
        batch = [r for r in rows if r[3] == d]
        before = dict(power)
        for c, s, o, _, *rest in batch:
            y_hat = predict(before.get(s, 0.0), before.get(o, 0.0), rest[2])
            out[(c, s)] = [y_hat, before.get(s, 0.0), before.get(o, 0.0)]
            y = pick(rest)
            step = 0.0 if y is None else 0.25 * alpha * (y - y_hat)
            power[s] = power.get(s, 0.0) + step
            power[o] = power.get(o, 0.0) - step
        for c, s, o, *_ in batch:
            out[(c, s)] += [power[s], power[o]]
    return out, power


SIG = lambda x: 1 / (1 + math.exp(-x))
CASES = {
    "real": (lambda df: R.rating_real(df, K, ["y"], 0.4), lambda r: r[0], lambda a, b, o: a - b),
    "binary": (lambda df: R.rating_binary(df, K, ["win"], 0.4), lambda r: r[1], lambda a, b, o: SIG(a - b)),
    "offset": (lambda df: R.rating_binary_offset(df, K, ["win"], 0.4, "offset"), lambda r: r[1], lambda a, b, o: SIG(o + a - b)),
}


@pytest.mark.parametrize("kind,values", [("real", 4_000_000), ("real", 30), ("real", 8), ("binary", 4_000_000), ("binary", 8), ("offset", 30)])
def test_matches_plain_loop(spark, monkeypatch, kind, values):
    # One window; windows of few dates; and single dates that are split.
    monkeypatch.setattr(R, "WINDOW_VALUES", values)
    fit, pick, predict = CASES[kind]
    rows = table()
    want, power = loop(rows, pick, predict, 0.4)
    result = fit(spark.createDataFrame(rows, SCHEMA))
    got = result.features.collect()
    assert len(got) == len(rows)
    for r in got:
        have = [r.pred, r.side_before, r.opp_before, r.side_after, r.opp_after]
        assert max(abs(a - b) for a, b in zip(have, want[(r.contest, r.side)])) < 1e-9
    state = {r.entity: r.rating for r in result.state.collect()}
    assert all(abs(state[e] - power[e]) < 1e-9 for e in power)
    if kind != "offset":
        assert abs(sum(state.values())) < 1e-9


def test_sparse_contests_take_few_rounds(spark, monkeypatch, capsys):
    """Groups of four entities that never meet another group: all their dates go in one round, on many tasks."""
    monkeypatch.setattr(R, "WINDOW_VALUES", 400)
    rng, rows = random.Random(9), []
    for i in range(800):
        g = i % 40
        a, b = rng.sample([f"g{g}-{x}" for x in "abcd"], 2)
        d = dt.date(2020, 1, 1) + dt.timedelta(days=i // 8)
        y = rng.gauss(0, 1)
        rows += [(f"k{i}", a, b, d, y, None, 0.0, 1.0, 2.0), (f"k{i}", b, a, d, -y, None, 0.0, 1.0, 2.0)]
    rows += [("null", None, "g0-a", dt.date(2020, 2, 1), 1.0, None, 0.0, 1.0, 2.0), ("nulls", None, None, dt.date(2020, 2, 1), 1.0, None, 0.0, 1.0, 2.0)]
    result = R.rating_real(spark.createDataFrame(rows, SCHEMA), K, ["y"], 0.4)
    want, power = loop([r for r in rows if r[1]], lambda r: r[0], lambda a, b, o: a - b, 0.4)
    dates = len({r[3] for r in rows})
    with capsys.disabled():
        print(f"\n{result.windows} round(s) for {dates} dates and {len(rows)} rows, at most 400 a task")
    assert result.windows < dates / 5 and result.rated.count() == len(rows)
    state = {r.entity: r.rating for r in result.state.collect()}
    assert set(state) == set(power) and all(abs(state[e] - power[e]) < 1e-9 for e in power if not e.startswith("g0-"))


@pytest.mark.parametrize("values", [4_000_000, 300, 20])
def test_wide_grids_are_kept_by_entity_and_period(spark, monkeypatch, values):
    """Nine steps: one window, windows of few dates, split dates; what is written has no contest in it."""
    monkeypatch.setattr(R, "WINDOW_VALUES", values)
    written = []
    kept = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label, *a: written.append((label, df.columns)) or kept(df, label, *a))
    rows, steps = table(), [k / 10 for k in range(1, 10)]
    result = R.rating_real(spark.createDataFrame(rows + [("n", None, "a", dt.date(2020, 1, 2), None, None, 0.0, 1.0, 2.0)], SCHEMA), K, ["y"], steps)
    got = {(r.contest, r.side, r.cell): r for r in result.features.collect()}
    assert len(got) == 9 * (len(rows) + 1)
    history = {(r.cell, r.period, r.entity): (r.before, r.after) for r in result.history.collect()}
    for step in (0.1, 0.4, 0.9):
        want, power = loop(rows, lambda r: r[0], lambda a, b, o: a - b, step)
        for (c, s), w in want.items():
            r = got[c, s, f"y@{step}"]
            assert max(abs(a - b) for a, b in zip([r.pred, r.side_before, r.opp_before, r.side_after, r.opp_after], w)) < 1e-9
            d = next(str(x[3]) for x in rows if x[0] == c)
            assert max(abs(a - b) for a, b in zip(history[f"y@{step}", d, s], (w[1], w[3]))) < 1e-9
        state = {r.entity: r.rating for r in result.state.where(F.col("cell") == f"y@{step}").collect()}
        assert set(state) == set(power) and all(abs(state[e] - power[e]) < 1e-9 for e in power)
    assert not any(label == "rated" for label, _ in written)


def test_wide_accuracy_equals_narrow(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    steps = [k / 100 for k in range(1, 10)]
    wide = {(r.contest, r.side): r.p_hat for r in R.rating_accuracy(df, K, {"q": ("l", "t")}, steps).features.where("cell = 'q@0.05'").collect()}
    narrow = {(r.contest, r.side): r.p_hat for r in R.rating_accuracy(df, K, {"q": ("l", "t")}, 0.05).features.collect()}
    assert set(wide) == set(narrow) and all(abs(wide[k] - narrow[k]) < 1e-12 for k in wide)


def test_nothing_to_rate(spark):
    result = R.rating_real(spark.createDataFrame([], SCHEMA), K, ["y"], 0.4)
    assert result.features.count() == result.state.count() == result.history.count() == 0


def test_state_continues(spark):
    rows = table()
    cut = dt.date(2020, 1, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.entity: r.rating for r in R.rating_real(df, K, ["y"], 0.4).state.collect()}
    first = R.rating_real(df.where(F.col("d") < F.lit(cut)), K, ["y"], 0.4)
    rest = R.rating_real(df.where(F.col("d") >= F.lit(cut)), K, ["y"], 0.4, state=first.state)
    assert all(abs(r.rating - whole[r.entity]) < 1e-9 for r in rest.state.collect())


def test_grid_and_prediction(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    wide = R.rating_multi(df, K, {"y": 0.4, "win": 0.2}, "real")
    single = {(r.contest, r.side): r.pred for r in R.rating_real(df, K, ["y"], 0.4).features.collect()}
    assert all(abs(r.pred_y - single[(r.contest, r.side)]) < 1e-9 for r in wide.collect())
    many = R.rating_real(df, K, ["y"], [0.1, 0.4])
    assert {r.cell for r in many.state.select("cell").distinct().collect()} == {"y@0.1", "y@0.4"}
    new = spark.createDataFrame([("a", "nobody")], "side string, opp string")
    rated = {r.cell: r for r in R.rating_predict(new, many.state, K).collect()}
    assert rated["y@0.4"].opp_rating == 0.0 and rated["y@0.4"].pred == rated["y@0.4"].side_rating


def test_accuracy_ratings(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    seen = [(r[7], r[8]) for r in rows if r[7] is not None]
    p = sum(x for x, _ in seen) / sum(t for _, t in seen)
    b = math.log(p / (1 - p))
    off, dfn, want = {}, {}, {}
    for d in sorted({r[3] for r in rows}):
        o0, d0 = dict(off), dict(dfn)
        for r in [r for r in rows if r[3] == d]:
            s, o, l, t = r[1], r[2], r[7], r[8]
            p_hat = SIG(o0.get(s, 0.0) - d0.get(o, 0.0) + b)
            want[(r[0], s)] = p_hat
            step = 0.0 if l is None else 0.5 * 0.05 * (l - t * p_hat)
            off[s], dfn[o] = off.get(s, 0.0) + step, dfn.get(o, 0.0) - step
    result = R.rating_accuracy(df, K, {"q": ("l", "t"), "again": ("l", "t")}, 0.05)
    got = result.features.where("cell = 'q'").collect()
    assert len(got) == len(rows) and all(abs(r.p_hat - want[(r.contest, r.side)]) < 1e-9 for r in got)
    feats = R.accuracy_features(result, K).where("cell = 'again'").collect()
    by = {(r.contest, r.side): r.p_diff for r in feats}
    assert all(abs(v + by[(c, next(s2 for (c2, s2) in by if c2 == c and s2 != s))]) < 1e-12 for (c, s), v in by.items())


def test_components_are_white(spark):
    rng = random.Random(4)
    data = [(i, "uv"[i % 2], rng.gauss(3, 2), rng.gauss(0, 5), None if i == 5 else rng.gauss(1, 1)) for i in range(200)]
    df = spark.createDataFrame(data, "i int, g string, a double, b double, c double")
    out = R.pca_components(df, ["a", "b", "c"], 2, "g")
    s = out.agg(F.avg("pc_0"), F.var_samp("pc_0"), F.var_samp("pc_1"), F.covar_samp("pc_0", "pc_1"), F.count("pc_0")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9 and abs(s[2] - 1) < 1e-9 and abs(s[3]) < 1e-9 and s[4] == 199


def test_connected_contests_give_their_task_little(spark, monkeypatch):
    """A dense graph: tasks write entities and periods, few windows look for components, and hardly any is walked twice."""
    monkeypatch.setattr(R, "WINDOW_VALUES", 200)
    written, tried = [], []
    kept, parts = R.materialize, R.connected
    monkeypatch.setattr(R, "materialize", lambda df, label, *a: written.append((label, df.columns)) or kept(df, label, *a))
    monkeypatch.setattr(R, "connected", lambda *a: tried.append(1) or parts(*a))
    rng, rows = random.Random(4), []
    for i in range(700):
        a, b = rng.sample([f"e{x}" for x in range(12)], 2)
        d, y = dt.date(2020, 1, 1) + dt.timedelta(days=i // 7), rng.gauss(0, 1)
        rows += [(f"k{i}", a, b, d, y, None, 0.0, 1.0, 2.0), (f"k{i}", b, a, d, -y, None, 0.0, 1.0, 2.0)]
    result = R.rating_real(spark.createDataFrame(rows, SCHEMA), K, ["y"], 0.4)
    want, power = loop(rows, lambda r: r[0], lambda a, b, o: a - b, 0.4)
    state = {r.entity: r.rating for r in result.state.collect()}
    assert all(abs(state[e] - power[e]) < 1e-9 for e in power)
    assert len(tried) <= 1 + result.windows / R.TRIED and result.windows <= 10
    assert [columns for label, columns in written if label in ("history", "rated")] == [R.HISTORY] * result.windows


def test_equal_loadings_have_one_sign(spark):
    """Two columns scaled by their deviations load alike but for rounding: the last one is positive."""
    rng, rows = random.Random(2), []
    for i in range(200):
        x = rng.gauss(0, 1)
        rows.append((str(i), x, -x + rng.gauss(0, 1)))
    got = R.pca_components(spark.createDataFrame(rows, "contest string, a double, b double"), ["a", "b"], 1).collect()
    mean = sum(r.b for r in got) / len(got)
    assert sum(r.pc_0 * (r.b - mean) for r in got) > 0
