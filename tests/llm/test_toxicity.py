import random
import zlib

import duckdb
import numpy as np
import pytest

from duelframe.llm import queries, toxicity as tox
from duelframe.llm.common import WordHashes, settle

from ..conftest import SF

SMALL = 1 << 12


def out_of_reach(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def corpus(n=900, seed=1):
    """Documents in two languages; toxic ones hold a word or, in the second, a pair of words that alone are harmless."""
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        lang = draw.choice(["aa", "bb"])
        words = [f"{lang}{draw.randint(0, 150)}" for _ in range(draw.randint(3, 80))]
        toxic = draw.random() < 0.25
        bad = [draw.choice(["vile", "Foul"])] if lang == "aa" else ["go", "away"]
        if not toxic and lang == "bb" and draw.random() < 0.5:
            words.insert(0, "away")
            words.append("go")
        if toxic:
            at = draw.randint(0, len(words))
            words[at:at] = bad
        rows.append((k, " ".join(words), lang))
        labels.append((k, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = settle(spark).createDataFrame([(*r, "src", 9, 0.5) for r in rows], "doc_id long, text string, lang string, source string, toxic int, score double")
    return docs, spark.createDataFrame([(i, y, 1) for i, y in labels], "doc_id long, toxic int, quality int")


def table(df):
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and [t for _, t in df.dtypes] == ["bigint", "boolean", "double", "int"]
    return sorted(map(tuple, df.collect()), key=str)


def test_held_out_accuracy_and_labels_out_of_reach(spark):
    rows, labels = corpus()
    found = table(tox.score(*frames(spark, rows, labels), buckets=SMALL))
    truth = dict(labels)
    held = [r for r in found if r[1]]
    assert len(found) == len(rows) and all(r[1] == out_of_reach(r[0]) and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in found)
    assert np.mean([r[3] == truth[r[0]] for r in held]) > 0.95
    # Held-out labels, languages and sources do not matter.
    other = [(i, 1 - y if out_of_reach(i) else y) for i, y in labels]
    blind = [(i, t, None if out_of_reach(i) else lang) for i, t, lang in rows]
    assert table(tox.score(*frames(spark, blind, other), buckets=SMALL)) == found


def plain_logit(model, ids):
    """Window by window, as the classifier is defined."""
    padded = [0] * tox.PAD + list(ids) + [0] * tox.PAD
    features = []
    for w, filters, bias in zip(tox.WIDTHS, model.filters, model.bias):
        windows = [np.concatenate([model.embedding[x] for x in padded[k:k + w]]) @ filters for k in range(len(padded) - w + 1)]
        features.append(np.maximum(np.max(windows, axis=0) + bias, 0))
    return float(np.concatenate(features) @ model.out + model.intercept)


def test_pooling_equals_window_by_window(monkeypatch):
    rows, labels = corpus(200)
    ids = tox.word_ids([t.encode() for _, t, _ in rows] + [None, b"", b"  12 ", "é Ü".encode()], WordHashes(), SMALL)
    model = tox.fit_model(ids[:200], [y for _, y in labels], [r[2] for r in rows], [k % 5 == 0 for k in range(200)], SMALL, epochs=1)
    expected = [plain_logit(model, x) for x in ids]
    assert np.allclose(model.logits(ids), expected, atol=1e-4)
    monkeypatch.setattr(tox, "PIECE", 7)
    assert np.allclose(model.logits(ids), expected, atol=1e-4)
    assert [model.languages[k] for k in model.language(ids[:200])] == [r[2] for r in rows]


def test_gradients_follow_the_loss():
    """Training lowers the loss of what it is trained on, far below that of the share alone."""
    rows, labels = corpus(300)
    ids, y = tox.word_ids([t.encode() for _, t, _ in rows], WordHashes(), SMALL), np.array([float(v) for _, v in labels])
    loss = lambda m: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * m.logits(ids)))))
    losses = [loss(tox.train(ids, y, SMALL, epochs=e)) for e in (0, 2, 40)]
    share = y.mean()
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.3 * -(share * np.log(share) + (1 - share) * np.log(1 - share))


@pytest.mark.parametrize("logits, labels, least, most", [([0, 1, 2, 3], [0, 0, 1, 1], 1, 2), ([0, 1, 5, 6], [0, 1, 0, 1], 0, 6), ([1, 1, 1], [0, 1, 1], -9, 9), ([1], [1], 0, 0), ([], [], 0, 0)])
def test_thresholds(logits, labels, least, most):
    assert least <= tox.best_threshold(np.array(logits, float), np.array(labels, float)) <= most


def test_defined_results(spark):
    rows, labels = corpus(300)
    odd = [(None, "vile", "aa"), (1000, None, None), (1001, "", "aa"), (1001, "", "aa"), (1002, "12", ""), (1003, "aa1 " * 70_000 + "vile", "aa"), (1004, "\0", "aa")]
    found = table(tox.score(*frames(spark, rows + odd, labels + [(None, 1), (1002, 7), (1001, None), (5, 1 - dict(labels)[5])]), buckets=SMALL))
    assert len(found) == 307
    by = {r[0]: r for r in found}
    assert by[1000][2] == by[1001][2] == by[1004][2] and not by[None][1] and by[1003][3] == 1
    assert table(tox.score(*frames(spark, [], labels), buckets=SMALL)) == []
    assert {r[2] for r in table(tox.score(*frames(spark, rows[:20], []), buckets=SMALL))} == {0.0}
    assert {r[2] for r in table(tox.score(*frames(spark, rows[:20], [(k, 1) for k in range(20)]), buckets=SMALL))} == {0.0}


def test_query_on_the_given_tables(spark):
    larger = SF.replace("sf0.001", "sf0.01")
    found = {r.doc_id: r for r in queries.QUERIES["op13_toxicity"](spark, larger).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{larger}/labels.parquet'").fetchall()
    held = [(found[i].predicted, y) for i, y in labels if found[i].held_out]
    assert np.mean([p for p, y in held if y]) > 0.6 and np.mean([p for p, y in held if not y]) < 0.05


def test_every_labelled_document_teaches(spark, monkeypatch):
    """no sample, no cut of long texts; counts, rounds and thresholds run over all shards."""
    rows, labels = corpus(600)
    rows[0] = (0, "aa1 " * 6000 + "vile", "aa")  # more words than were learned from before
    monkeypatch.setattr(tox, "SHARD_DOCS", 100)
    docs, marks = frames(spark, rows, labels)
    monkeypatch.setattr(tox, "MANY", 50)  # many documents: a slice a round
    written = tox.shards(docs, marks, buckets=SMALL).collect()
    taught = [(i, t) for i, t, _ in rows if not out_of_reach(i)]
    assert len(written) == len(taught) and sorted(len(r.ids) // 4 for r in written) == sorted(len(t.split()) for _, t in taught)
    seen, whole = [], tox._round
    monkeypatch.setattr(tox, "_round", lambda part, *a: seen.append(part.count()) or whole(part, *a))
    found = table(tox.score(docs, marks, buckets=SMALL))
    assert len(seen) == tox.ROUNDS and sum(seen) == sum(not r.back for r in written)
    truth = dict(labels)
    assert np.mean([r[3] == truth[r[0]] for r in found if r[1]]) > 0.85


def test_a_long_text_wins_by_its_best_piece(monkeypatch):
    rows, labels = corpus(60)
    ids = tox.word_ids([t.encode() for _, t, _ in rows], WordHashes(), SMALL)
    learner = tox.Learner(tox.train(ids, np.array([float(y) for _, y in labels]), SMALL, epochs=1))
    want = learner.winners(ids)
    monkeypatch.setattr(tox, "PIECE", 9)
    got = learner.winners(ids)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(want[0], got[0]))
    assert tox.passes(10) == 6 and tox.passes(tox.MANY * 2) == 3 and tox.passes(10 ** 9) == 1
