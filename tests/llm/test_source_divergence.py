import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from duelframe.llm import source_divergence as div
from duelframe.llm.common import settle

FIELDS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", [t.translate(fold) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    df, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang][source].update(terms)
    out = []
    for lang, by_source in counts.items():
        kept = [t for t, n in df[lang].items() if n >= 3]

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in by_source.items()}
        whole = shares(sum(by_source.values(), Counter()))
        for s in p:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in p if o != s]
            terms = [(-((p[s][t] - whole[t]) ** 2 // whole[t]), t) for t in kept if by_source[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return settle(spark).createDataFrame([(*r, "t", 3) for r in rows], "lang string, source string, text string, term string, n int")


def result(df):
    assert df.columns == FIELDS and [t for _, t in df.dtypes] == ["string"] * 4 + ["bigint", "int"]
    return sorted(map(tuple, df.collect()))


def corpus(seed, sources=7, docs=150, words=60):
    draw = random.Random(seed)
    known = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{'x' * (k // 676)}{'é' * (k % 3)}" for k in range(words)]
    rows = []
    for _ in range(docs):
        s = draw.choice([0] * sources + list(range(sources)))
        rows.append((draw.choice(["en", "de", "én", None]), f"s{s}", " ".join(draw.choice(known[s:]).title() + draw.choice(["", "-", "\0", "1", " "]) for _ in range(draw.randint(0, 40)))))
    rows += [("en", None, None), ("en", "", ""), ("xx", "only", "a a a"), ("yy", "a", "q"), ("yy", "b", "q"), ("en", "s0", "é" * 30_000 + " word " * 20_000)]
    return rows + rows[:20]


@pytest.mark.parametrize("settings", [{}, {"head_bytes": 1500, "shard_keys": 5, "slot_bytes": 400, "tile": 2, "term_shards": 3}, {"head_bytes": 0, "tile": 3}])
def test_against_brute_force(spark, settings, monkeypatch):
    if settings:
        monkeypatch.setattr(div, "HELD", 60)
        monkeypatch.setattr(div, "TILE_ROWS", 40)
    rows = corpus(1)
    assert result(div.divergence(frame(spark, rows), **settings)) == brute(rows)


def test_more_than_the_top_terms(spark, monkeypatch):
    monkeypatch.setattr(div, "HELD", 50)
    rows = [(lang, s, text) for lang, s, text in corpus(2, words=2000, docs=2500, sources=2) if lang == "en"]
    found = result(div.divergence(frame(spark, rows)))
    assert found == brute(rows) and max(r[5] for r in found if r[2] == "term") == 200


def test_nothing(spark):
    assert result(div.divergence(frame(spark, []))) == []
    assert result(div.divergence(frame(spark, [(None, None, None)]))) == []
    assert result(div.divergence(frame(spark, [("a", "x", "b"), ("a", "y", None)]))) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]


def test_perfect_hash_has_no_gap_and_knows_its_keys(spark):
    draw = np.random.default_rng(3)
    for n in (1, 2, 7, 5000):
        slots, maps = div.build_levels(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        assert sorted(slots) == list(range(n)) and sum(map(len, maps)) < 5 * n + 20
    rows = [(b"en", b"w%d" % k) for k in range(900)] + [(b"", b"w1"), (b"de", b"w1")]
    slots = div.perfect_hashes(settle(spark).createDataFrame(rows, "lang binary, term binary"), 100)
    assert slots.ways == 10 and sorted(slots.find([a + b"\0" + b for a, b in rows])) == list(range(902))
    assert (slots.find([b"en\0absent%d" % k for k in range(3000)]) == -1).all()
    assert [len(slots.of_lang[lang]) for lang in (b"en", b"", b"de")] == [900, 1, 1]


def test_shares_beyond_64_bits(spark):
    edge = (1 << 62) // div.SCALE
    rows = [(n, 10**14, 10**6) for n in (90_000_000_000_000, edge - 2, edge - 1, edge, edge + 1, 0)] + [(0, 0, 0), (0, 0, 7)]
    found = settle(spark).createDataFrame(rows, "n long, total long, terms long")
    found = found.select("*", div._share(found.n, found.total, found.terms, div.SCALE).alias("p")).collect()
    assert len(found) == 8 and all(r.p == (1 + 10**9 * (r.n + 1) // (r.total + r.terms) if r.terms else None) for r in found)
