import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from duelframe.llm import exact_dedup, near_dedup
from duelframe.llm.common import settle

DOCS = "doc_id long, text string, source string, key string, id string, body string, row string"


def docs(spark, rows):
    return settle(spark).createDataFrame([(i, t, "s", "k", "x", "b", "r") for i, t in rows], DOCS)


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t in rows), key=str)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 300_000), (6, "b" * 300_000), (7, "ü"), (7, "ü"), (None, "n"), (None, "a"), (9, "A")]
ROWS += [(100 + k, f"text {k % 40}") for k in range(200)]


@pytest.mark.parametrize("bits,bucket_rows", [(63, 1024), (63, 2), (3, 4), (1, 1)])
def test_exact_membership(spark, bits, bucket_rows):
    found = exact_dedup.membership(docs(spark, ROWS), bits=bits, bucket_rows=bucket_rows).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str) == expected_exact(ROWS)


def test_exact_chains_and_directory(spark):
    index = exact_dedup.build_index(docs(spark, ROWS), bits=6, bucket_rows=3)
    entries = index.entries.collect()
    assert max(e.chain for e in entries) > 0 and len({(e.key, e.chain) for e in entries}) == len(entries)
    slots = index.directory.collect()
    directory = {(r.prefix, r.depth): r["keys"] for r in slots}
    deepest = max(depth for _, depth in directory)
    assert len({r.slot for r in slots}) == len(slots) and all(r.slot >> (deepest - r.depth) == r.prefix for r in slots)
    assert {r.slot for r in index.keys.collect()} <= {r.slot for r in slots}
    assert all(n <= 3 or depth == 6 for (_, depth), n in directory.items())
    assert all((e.bucket, e.depth) in directory and e.key >> (6 - e.depth) == e.bucket for e in entries)


def test_exact_owners_share_a_crowded_stretch_of_keys(spark):
    """Nine tenths of the keys lie in a 256th of their range: their buckets split until owners hold about as many keys."""
    crowded = [k * 3 for k in range(9000)] + [(1 << 24) + k * ((1 << 32) // 1000) for k in range(1000)]
    keys = settle(spark).createDataFrame([(k,) for k in crowded], "key long").repartition(4)
    directory = exact_dedup.grow_directory(keys, 33, 50)
    assert max(r["keys"] for r in directory.buckets.collect()) <= 50 and directory.depth > 15
    first = directory.owners(8)
    held = np.bincount(np.searchsorted(first, crowded, side="right") - 1)
    assert len(first) == 8 and held.min() > 0 and held.max() < 2 * len(crowded) / 8


def test_exact_a_text_outside_the_directory_raises():
    columns = {"key": [0, 5, 40], "chain": [-1, 0, 0], "bucket": [0, 0, 0], "depth": [2, 0, 0]}
    batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], list(columns))
    with pytest.raises(RuntimeError):
        list(exact_dedup._placed([batch], 6))


def test_exact_keep_one(spark):
    kept = exact_dedup.keep_one(docs(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "source", "key", "id", "body", "row"]
    rows = kept.collect()
    assert len(rows) == len({t or "" for _, t in ROWS})
    assert {r.doc_id for r in rows} == {keep for _, keep, _, _ in expected_exact(ROWS)}


def test_exact_empty(spark):
    empty = docs(spark, [])
    assert exact_dedup.membership(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def sets_of(text, size):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1))


def expected_near(rows, size=2, percent=80):
    sets = {i: sets_of(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def near_rows():
    base = [f"w{k * 7919 % 1000}" for k in range(120)]
    rows = [(k, " ".join(base[:k % 10] + [f"x{k}"] + base[k % 10:])) for k in range(60)]
    rows += [(100 + k, " ".join(base[k:k + 100])) for k in range(0, 20, 2)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "two one"), (207, "É a"), (208, "é a")]
    return rows + [(300 + k, " ".join(f"y{k}_{j}" for j in range(30))) for k in range(20)] + [(400, " ".join(f"z{j}" for j in range(60_000)))]


@pytest.mark.parametrize("settings", [{}, {"size": 5}, {"hot_least": 5, "hot_share": 1}])
def test_near_components(spark, settings):
    rows = near_rows()
    found = near_dedup.components(docs(spark, rows), **settings).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == expected_near(rows, settings.get("size", 2))


def test_near_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "x")]
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.components(docs(spark, rows)).collect()), key=str)
    assert found == sorted([(None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)], key=str)
    kept = near_dedup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and kept.count() == 5


def test_near_empty(spark):
    assert near_dedup.components(docs(spark, [])).count() == 0 and near_dedup.keep_one(docs(spark, [])).count() == 0


def test_connect_long_chain(spark):
    links = settle(spark).createDataFrame([(k + 1, k) for k in range(70)] + [(200, 201), (201, 202)], "u long, v long")
    assert {r.node: r.component for r in near_dedup.connect(links).collect()} == {**{k: 0 for k in range(71)}, 200: 200, 201: 200, 202: 200}


def crowd_rows(n=500, paragraphs=100, taken=90):
    """Documents of most of the same paragraphs: they share most buckets, and few pairs are links."""
    draw = random.Random(1)
    return [(k, " ".join(f"p{j}_{w}" for j in sorted(draw.sample(range(paragraphs), taken)) for w in range(2))) for k in range(n)]


def expected_crowd(rows, side, minhashes):
    """Components over the links that share a bucket of a table."""
    batch = pa.RecordBatch.from_pydict({"id": [k for k, _ in rows], "text": [t for _, t in rows]})
    made = next(iter(near_dedup._sketches(2, side, minhashes)([batch])))
    a, b = (np.array(made.column(c).to_pylist()) for c in ("a", "b"))
    meet = (a[:, None] == a).any(2) & (b[:, None] == b).any(2)
    sets = [sets_of(t, 2) for _, t in rows]
    number = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(number)), np.float32)
    for k, members in enumerate(sets):
        held[k, [number[s] for s in members]] = 1
    both, size = held @ held.T, held.sum(1)
    links = np.argwhere(meet & (100 * both >= 80 * (size[:, None] + size - both)))
    component = np.arange(len(rows))
    while (component[links[:, 1]] != component[links[:, 0]]).any():
        np.minimum.at(component, links[:, 0], component[links[:, 1]])
    return component


@pytest.mark.parametrize("settings", [{}, {"block": 20}, {"hot_least": 5, "hot_share": 100}])
def test_near_links_in_a_crowd(spark, settings):
    rows = crowd_rows()
    expected = expected_crowd(rows, 1, 1)
    assert 10 < (expected != np.arange(len(rows))).sum() < 250
    found = {r.doc_id: r.component_id for r in near_dedup.components(docs(spark, rows), side=1, rows=1, **settings).collect()}
    assert [found[k] for k, _ in rows] == expected.tolist()
