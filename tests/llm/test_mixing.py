import random
from fractions import Fraction

import pytest

from duelframe.llm import mixing
from duelframe.llm.common import settle


def highest_quotients(weights, seats):
    """All seats awarded one at a time."""
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (Fraction(weights[i]) / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_sainte_lague_awards_the_highest_quotients():
    draw = random.Random(3)
    for _ in range(300):
        weights = [draw.choice([0, 1, 2, 3, 5, 50, draw.randint(0, 1000)]) for _ in range(draw.randint(1, 8))]
        seats = draw.randint(0, 60)
        assert mixing.sainte_lague(weights, seats) == (highest_quotients(weights, seats) if sum(weights) else [0] * len(weights))


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    # The third source stops at 30 and the rest goes 1 : 2.
    assert mixing.targets([100, 100, 10], [1, 2, 3]) == [60, 120, 30]
    assert mixing.targets([0, 10], [1, 1]) == [0, 10] and mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0]


def rows():
    draw = random.Random(5)
    out = [(k, " ".join(["w"] * draw.choice([0, 1, 5, 30, 400])), draw.choice(["b", "a", "a", "a", "É", "", None])) for k in range(400)]
    return out + [(None, "x y", "a"), (None, "x y", "a"), (7, "x y z", "a"), (7, "x y z", "a"), (1000, None, "a"), (1001, " ", None), (1002, "long " * 30_000, "b")]


def table(spark, data):
    return settle(spark).createDataFrame([(i, t, s, 0, 0) for i, t, s in data], "doc_id long, text string, source string, size int, shard int")


def test_mix(spark):
    data = rows()
    found = mixing.mix(table(spark, data)).collect()
    again = mixing.mix(table(spark, data)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str) and len(found) == len(data)
    sizes, by_source = {}, {}
    for _, text, source in data:
        by_source[source] = by_source.get(source, 0) + len((text or "").split())
    sources = sorted(by_source, key=lambda s: (s is None, s or ""))
    goals = mixing.targets([by_source[s] for s in sources], [1, 2, 3, 1, 2, 3][:len(sources)])
    sizes = {s: (by_source[s], float(g)) for s, g in zip(sources, goals)}
    assert sorted({(r.source_size, r.target) for r in found}) == sorted(set(sizes.values()))
    for size, target in sizes.values():
        own = [r for r in found if (r.source_size, r.target) == (size, target)]
        assert abs(sum(r.taken for r in own) - target) <= 1
    assert all(0 <= r.taken <= 3 * r["size"] for r in found)
    assert sorted(found, key=key)[0]["size"] == len(data[0][1].split())


def test_apply_mix(spark):
    data = rows()
    docs = table(spark, data)
    kept = mixing.apply_mix(docs)
    assert kept.columns == docs.columns
    counts = {}
    for r in kept.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 9 and 1000 not in counts and 1001 not in counts
    assert max(n for i, n in counts.items() if i not in (None, 7)) <= 3


def test_empty(spark):
    empty = table(spark, [])
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    blank = table(spark, [(1, None, None), (2, "", "a")])
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_takes_meet_the_goal(block):
    draw = random.Random(block)
    for _ in range(100):
        shards = [draw.randint(0, 300) for _ in range(draw.randint(1, 9))]
        goal = draw.randint(0, 3 * sum(shards))
        take = mixing._takes(shards, block, goal // block, goal, 3)
        assert sum(take) == goal and all(0 <= t <= 3 * s for t, s in zip(take, shards))
