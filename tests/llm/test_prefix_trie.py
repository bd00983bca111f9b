import hashlib
import random
import zlib
from collections import defaultdict

from duelframe.llm import prefix_trie as trie
from duelframe.llm.common import settle

SCHEMA = "conv_id long, turn int, role string, text string, depth string, node long, c long"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5 if c < 0 else c % 5
        out[c] = own.get(c - base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    found = []

    def walk(path):
        leaves, saved = int(not children[path]), (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        for child in children[path]:
            more = walk(child)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = ",".join(str(c) for c in sorted(members[path]) if len(convs[c]) == len(path))
        found.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if convs:
        walk(())
    return sorted(found, key=str)


def frame(spark, rows):
    return settle(spark).createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(map(tuple, df.collect()), key=str)


def crowd(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, 60), 77, 101, 1000, -3, -5, -6]:
        for t in range(draw.choice([1, 1, 2, 4, 9, 12])):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["", "a", "é😀", "b" * 50])))
    rows += [(c, t, "user" if t % 2 else None, f"said {t}") for c in range(200, 260) for t in range(9)]  # one common conversation
    rows += [(300, 0, "user", "a"), (300, 0, "user", "a"), (300, None, None, None), (301, 5, "user", "a"), (301, 5, "assistant", "b"), (None, 1, "user", "a")]
    draw.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = crowd(1)
    expected = brute(rows)
    assert result(trie.conversation_trie(frame(spark, rows))) == expected
    assert any(r[3] > 40 and r[1] == 9 for r in expected)


def test_hot_conversations_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 20)
    draw = random.Random(2)
    rows = crowd(3) + [(500, t, "user", draw.choice("ab")) for t in range(400)]
    assert result(trie.conversation_trie(frame(spark, rows), hot_rows=25)) == brute(rows)


def test_few_and_none(spark):
    assert result(trie.conversation_trie(frame(spark, []))) == []
    assert result(trie.conversation_trie(frame(spark, [(None, 1, "user", "a")]))) == []
    # 3 takes h = crc32("3") % 9 turns of the absent 0 and has none of its own left.
    rows = [(3, 0, "user", "a")]
    assert zlib.crc32(b"3") % 9 and result(trie.conversation_trie(frame(spark, rows))) == brute(rows)
    long = [(10, 0, "user", "x" * 2_000_000), (10, 1, None, None), (11, 0, "user", "y" * 70 + "1"), (11, 0, "user", "y" * 70 + "2")]
    assert len(result(trie.conversation_trie(frame(spark, long)))) == len(brute(long))
