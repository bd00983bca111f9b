"""Literal tables for the parsers and price functions: normal, null, dash, malformed."""

import math

from pyspark.sql import functions as F

from duelframe.functions import dates as D, nested as N, odds as M, text as X


def one(spark, schema, row, **cols):
    return spark.createDataFrame([row], schema).select(*[c.alias(n) for n, c in cols.items()]).first()


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", fn("x").alias("y")).orderBy("i").collect()]


def test_x_of_y(spark):
    got = column(spark, ["10 of 20", "3of7", "--", None, "x of 4"], X.parse_x_of_y)
    assert [(r.landed, r.attempted) for r in got] == [(10, 20), (3, 7), (None, None), (None, None), (None, 4)]
    assert column(spark, ["3/7"], lambda c: X.parse_x_of_y(c, "/"))[0].attempted == 7


def test_clock(spark):
    assert column(spark, ["4:59", "--", "-", None, "0:00"], lambda c: X.mmss_to_seconds(c, 0)) == [299, 0, 0, 0, 0]
    assert column(spark, ["--", None], X.mmss_to_seconds) == [None, None]


def test_ids_and_numbers(spark):
    url = lambda c: X.id_from_url(c, "/fighter-details/")
    assert column(spark, ["http://h/fighter-details/abc", "http://h/x", None], url) == ["abc", None, None]
    assert column(spark, ["-", "1.5", "", None, "EVEN"], X.dash_to_null) == [None, 1.5, None, None, None]
    assert column(spark, ["-150▼", "120▲", "EVEN", None], X.strip_arrows) == [-150.0, 120.0, None, None]


def test_bio(spark):
    assert column(spark, ["5' 11\", 170 lbs", "6' 0\"", "x", None], X.feet_inches) == [71.0, 72.0, None, None]
    assert column(spark, ["5' 11\", 170 lbs", None], X.weight_lbs) == [170.0, None]
    assert column(spark, ['72"', '"', "", None], X.reach_inches) == [72.0, None, None, None]


def test_method_rules(spark):
    rows = [("submission (punches)", "W"), ("Submission (Armbar)", "W"), ("submission (armbar)", "D"), ("TKO", "L"), ("Decision", "W"),
            ("majority decision", "L"), ("technical decision (unanimous)", "W"), ("dq", "D"), ("no contest (dq)", "W"), (None, "W")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, res string")
    got = [r.m for r in df.select("i", X.classify_method("t", "res").alias("m")).orderBy("i").collect()]
    assert [m.outcome for m in got] == ["tko/ko", "submission", "draw", "tko/ko", "decision - unanimous", "decision - split",
                                        "technical decision", "dq", "nc", ""]
    assert [m.sub_method for m in got][:3] == ["punches)", "Armbar)", "armbar)"] and got[3].sub_method == ""
    assert column(spark, ["Technical Submission", "KO", "could not continue", "Split Decision", None, "dq"], X.classify_method_v2) == [
        "submission", "tko_ko", "tko_ko", "decision", "other", "other"]


def test_event_and_round_texts(spark):
    got = column(spark, ["UFC 285: Jones vs. Gane", "M-1 Challenge 12", None, "ONE - Reign"], X.promotion_name)
    assert [(g.name, g.flagged) for g in got] == [("ufc ", True), ("m-1 challenge ", False), ("", False), ("one", False)]
    got = column(spark, ["3 Rnd (5-5-5)", "Unlimited Rnd", "No Time Limit", "Unlimited Rnd (7)", None], X.round_format_minutes)
    assert got == [[5, 5, 5], [15] * 50, [999999], [7] * 50, None]
    assert column(spark, [" Southpaw ", "SWITCH", "open", None], X.stance_clean) == ["southpaw", "switch", "orthodox", "orthodox"]
    assert column(spark, ["x_belt.png", None], lambda c: X.suffix_flag(c, "belt.png")) == [True, False]


def test_key_values(spark):
    got = column(spark, ["Height: 5\nReach:7\nDOB: --"], lambda c: X.prefixed_values(c, {"h": "Height:", "r": "Reach:", "s": "STANCE:"}))[0]
    assert (got.h, got.r, got.s) == ("5", "7", None)


def test_dates(spark):
    formats = ["yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy"]
    got = column(spark, ["5/1/1990 (33)", "2020-02-03", "Mar 4, 2021", "x", None], lambda c: D.parse_mixed_date(c, formats))
    assert [str(g) if g else None for g in got] == ["1990-05-01", "2020-02-03", "2021-03-04", None, None]
    w = one(spark, "a date, b date", (__import__("datetime").date(2020, 1, 31), __import__("datetime").date(2020, 1, 1)), w=D.decay_weight("b", "a", 0.01)).w
    assert math.isclose(w, 0.99 ** (30 / 30.5))


def test_prices(spark):
    p = column(spark, [-150.0, 130.0, 0.0, None], M.american_to_prob, "double")
    assert [None if x is None else round(x, 6) for x in p] == [0.6, 0.434783, -0.0, None]
    assert column(spark, [-150.0, 130.0, 0.0, None], M.american_to_payout, "double")[2:] == [None, None]
    back = column(spark, [-150.0, 130.0, -400.0], lambda c: M.decimal_to_american(M.american_to_decimal(c)), "double")
    assert [round(x, 9) for x in back] == [-150.0, 130.0, -400.0]
    row = one(spark, "a double, b double", (0.6, 0.5), v=M.devig_pair("a", "b"), m=M.strict_least("a", F.lit(None).cast("double")))
    assert math.isclose(row.v.side + row.v.opp, 1.0) and row.m is None
    row = one(spark, "p double, q double", (0.9, 0.5), c=M.clip_adjustment("p", "q"), n=M.clip_adjustment("p", F.lit(None).cast("double")))
    assert math.isclose(row.c, 1 / (1 + math.exp(-0.2))) and row.n is None
    row = one(spark, "a double, b double", (None, 0.4), best=M.best_price(["a", "b"]), mean=M.consensus_prob(["a", "b"]), none=M.consensus_prob(["a", "a"]))
    assert (row.best, row.mean, row.none) == (0.4, 0.4, None)


def test_targets_and_durations(spark):
    row = one(spark, "r string, m string", ("L", "submission"), t=M.outcome_targets("r", "m")).t
    assert (row.win, row.win_finish, row.ordinal, row.submission, row.decision) == (0, 0, -2, -1, 0)
    row = one(spark, "a array<int>, r int, s int", ([5, 5, 5], 3, 60), d=M.contest_duration("a", "r", "s"), p=N.prefix_sum_array("a", F.lit(2)))
    assert (row.d, row.p) == (660, 10)
    row = one(spark, "w int, t int", (1, 10), a=M.signed_inverse_time("w", "t"), n=M.signed_inverse_time(F.lit(None), "t"))
    assert math.isclose(row.a, -1 / 60) and row.n is None
