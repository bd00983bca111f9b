"""The chunked path of running values against the plain one and against Python."""

import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators import careers as C
from duelframe.operators.bets import equity_curve

def specs():
    return {
        "n": C.n_prior_contests(), "cnt": C.running_count(), "flags": C.running_flag_count(F.expr("k % 3 = 0")),
        "tot": C.prior_total("x"), "mn": C.running_min("x"), "mx": C.running_max("x"), "prev": C.prev_value("x"),
        "nxt": C.Run("lead", "x"), "fill": C.ffill("x", -1), "before": C.Run("sum", "x", inclusive=False),
    }


def rows(n=400, seed=1):
    rng = random.Random(seed)
    # One entity holds more than a third of all rows, one is null.
    return [(rng.choice(["hot"] * 5 + ["a", "b", "c", None]), k, rng.choice([None, rng.randint(0, 50), rng.randint(0, 50)])) for k in range(n)]


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot_rows", [10, 60])
def test_chunked_equals_plain(spark, hot_rows):
    df = spark.createDataFrame(rows(), "e string, k int, x int")
    plain = C.with_running(df, "e", "k", specs(), hot_rows=None)
    chunked = C.with_running(df, "e", "k", specs(), hot_rows=hot_rows)
    assert plain.columns == chunked.columns
    assert collect(plain) == collect(chunked)


def test_against_python(spark):
    data = rows(120, 3)
    df = spark.createDataFrame(data, "e string, k int, x int")
    got = {(r.e, r.k): r for r in C.with_running(df, "e", "k", specs(), hot_rows=15).collect()}
    seen = {}
    for e, k, x in data:
        past = seen.setdefault(e, [])
        known = [v for v in past if v is not None]
        row = got[(e, k)]
        assert row.n == len(past) and row.cnt == len(past) + 1
        assert row.prev == (past[-1] if past else None)
        assert row.tot == (sum(known) if past and past[-1] is not None else 0)
        assert row.mn == (None if x is None else min(known + [x])) and row.mx == (None if x is None else max(known + [x]))
        assert row.fill == (x if x is not None else (known[-1] if known else -1))
        past.append(x)


def test_global_running_product(spark):
    data = [(i, 0.01 * ((i * 7) % 5 - 2)) for i in range(200)]
    df = spark.createDataFrame(data, "p int, ret double")
    value, want = 1.0, []
    for _, r in data:
        value *= 1 + r
        want.append(value)
    for hot in (None, 20):
        got = [r.portfolio for r in equity_curve(df, "p", hot_rows=hot).orderBy("p").collect()]
        assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9


def test_segments(spark):
    # header pair with one child pair, header pair without children, then event-level rows; the last pair disagrees
    page = [(1, True, 1, "a"), (2, True, 1, "b"), (3, False, None, "p"), (4, False, None, "q"), (5, True, None, "c"), (6, True, None, "d"),
            (7, False, None, "r"), (8, True, 1, "e"), (9, True, 2, "f")]
    df = spark.createDataFrame([("pg", *r) for r in page], "g string, i int, head boolean, n int, name string")
    got = C.segment_attribution(df, "g", "i", "head", "n", "name").orderBy("i").collect()
    assert [r.role for r in got] == ["side", "opp", "child", "child", "side", "opp", "event", "side", "opp"]
    assert [(r.side_name, r.opp_name) for r in got[2:4]] == [("a", "b")] * 2 and got[6].side_name is None
    assert [r.violation for r in got] == [False] * 8 + [True]
