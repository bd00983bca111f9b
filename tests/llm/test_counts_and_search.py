import random

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from duelframe.llm import token_counts as tokens
from duelframe.llm import topk_search as search
from duelframe.llm.common import settle
from duelframe.session import new_path

from ..conftest import SF


def library():
    tokenizer = Tokenizer.from_file(tokens.public_tokenizers.path(tokens.MODEL))
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_stretches_count_like_whole_texts():
    draw = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "'s", "12", "😀", "<|endoftext|>", "!", "　", "word"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()] + [" " * 3000, "x" * 3000]
    with open(tokens.public_tokenizers.path(tokens.MODEL), "rb") as f:
        counter = tokens.Counter(f.read(), limit=500)
    assert counter.count(texts[:2000]) + counter.count(texts[2000:]) == library()(texts)


def test_cache(spark, monkeypatch):
    rows = [(1, "a b"), (2, "a b"), (2, "a b"), (None, None), (4, ""), (5, "é " * 3000), (6, "<|endoftext|>")]
    docs = settle(spark).createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, digest string")
    cache = new_path(spark, "test-cache")
    expected = sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, library()([t or "" for _, t in rows]))), key=str)
    assert sorted(map(tuple, tokens.count_tokens(docs, cache=cache).collect()), key=str) == expected
    assert tokens.read_cache(spark, cache).count() == 4
    more = docs.unionByName(settle(spark).createDataFrame([(9, "new", "d")], docs.schema))
    assert tokens.count_tokens(more, cache=cache).count() == 8 and tokens.read_cache(spark, cache).count() == 5

    def broken(model):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    raise RuntimeError("encoded again")
                yield batch
        return run

    monkeypatch.setattr(tokens, "_count", broken)
    assert sorted(map(tuple, tokens.count_tokens(docs, cache=cache).collect()), key=str) == expected


def test_counts_of_nothing(spark):
    docs = settle(spark).createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(docs).count() == 0


def best(rows, every, k):
    out = []
    taking = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v))]
    for q, a in taking:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in taking if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def vectors(spark, rows):
    return settle(spark).createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(2)
    rows = [(k, [float(x) for x in np.float32(draw.integers(-3, 4, 6) / 4 * (draw.random(6) < 0.6))]) for k in range(700)]
    rows += [(701, None), (702, [None, 1.0]), (703, [float("nan")]), (704, [float("inf")]), (800, []), (801, [1.0]), (None, [1.0]), (900, [0.5] * 9), (5, list(rows[5][1])), (100, [1.0, 1.0])]
    found = search.search_table(vectors(spark, rows))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == best(rows, 100, 10)


def test_search_few_and_none(spark):
    assert sorted(map(tuple, search.search_table(vectors(spark, [(0, [1.0]), (1, [0.5]), (2, [-0.1])])).collect())) == [(0, 1, 1, 524288), (0, 2, 2, -105472)]
    assert search.search_table(vectors(spark, [])).count() == 0
    assert search.search_table(vectors(spark, [(0, [1.0])])).count() == 0


def test_scores_that_leave_64_bits():
    huge = search.Postings(np.array([1]), [np.array([1 << 40])])
    with pytest.raises(OverflowError):
        search.scores(huge, huge)
