"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling over the
whole text and a logistic output, trained with numpy, with a threshold for each language.

Learning takes every labelled document that is not held out, with its whole text; a share of them (`calibrate`), by a hash
of the id, is kept from training. Their words' buckets are written once, in shards of some `SHARD_DOCS` documents. Words' and
languages' counts are summed over all shards. Training goes in ROUNDS: every shard trains a copy of the model on a slice of
its documents, and the copies are averaged, a word's embedding over the shards that moved it. Few documents are seen EPOCHS
times, many at least once: as often as their number leaves it (`passes`). The first
coordinate of a word's embedding starts at its shrunken log odds, the rest at random; gradients flow through the
windows that win the pooling. On the documents kept from training the threshold of each language is the middle of the
widest of the gaps between scores that give the best F1, of scores counted in steps of 1/GRID; a language with fewer than
`least` toxic ones takes that of all.
A text's language, too, is told from its words alone, by the hashed words' frequencies in the languages of the documents
that were learned from. The score is the probability moved, on the logit scale, by the language's threshold to 0.7.

The model (embeddings, filters, word frequencies) is the only broadcast and of fixed size: `buckets` times
(`DIMENSIONS` + at most `MOST_LANGUAGES`) numbers. Texts are scored whole, in batches; a long one is scored in pieces whose
maxima meet, so memory does not grow with a text.

Defined results: a text without words, empty or null gets the score of a text of padding; without labelled documents
of both kinds every score is 0; repeated ids keep a row each, a row without an id is scored and not held out; conflicting labels of an id
count as toxic; labels other than 0 and 1 are no labels; other columns are not read, whatever their names.
"""

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from duelframe.session import BROADCAST_ROWS, materialize

from .common import WordHashes, settle, share, shared

BUCKETS, DIMENSIONS, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
CALIBRATE, LEAST = 0.2, 15
# Documents of a shard; rounds of training; documents that are seen EPOCHS times; steps of a logit that are counted apart.
SHARD_DOCS, ROUNDS, MANY, GRID, WIDEST = 8_192, 6, 16_384, 256, 64
# Tasks that sum what the shards give.
FAN = 16
EPOCHS, BATCH, RATE, DECAY, SHRINK = 6, 64, 0.003, 1e-4, 10.0
MOST_LANGUAGES, THRESHOLD, SEED = 16, 0.7, 11
# Words that are scored at once.
PIECE = 1 << 16
PAD = max(WIDTHS) - 1

# A-Z to a-z; what is no letter, digit or character beyond ASCII to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def word_ids(texts, cache: WordHashes, buckets=BUCKETS) -> list:
    """Buckets of the words of each text (bytes or None); 0 is padding."""
    return [(cache.of(t.translate(_FOLD).split()) % np.uint64(buckets - 1)).astype(np.int32) + 1 if t else np.empty(0, np.int32) for t in texts]


@dataclass
class Model:
    """Without parameters: nothing to learn from, all texts score 0."""
    embedding: np.ndarray | None = None
    filters: list = field(default_factory=list)  # one for each width: (width * dimensions, filters)
    bias: list = field(default_factory=list)
    out: np.ndarray | None = None
    intercept: float = 0.0
    languages: list = field(default_factory=list)
    of_language: np.ndarray | None = None  # log frequencies, bucket by language
    thresholds: np.ndarray | None = None   # on the logit scale, by language

    def pooled(self, flat: np.ndarray, starts: np.ndarray) -> tuple:
        """Pooled features of texts laid out in `flat` with PAD paddings before and behind each, and the winning windows."""
        vectors = self.embedding[flat]
        found, won = [], []
        for w, filters, bias in zip(WIDTHS, self.filters, self.bias):
            n = len(flat) - w + 1
            scores = np.zeros((n, filters.shape[1]), np.float32)
            for k in range(w):
                scores += vectors[k:n + k] @ filters[k * DIMENSIONS:(k + 1) * DIMENSIONS]
            best = np.maximum.reduceat(scores, starts, axis=0)
            found.append(np.maximum(best + bias, 0))
            won.append((scores, best))
        return np.concatenate(found, 1), won

    def logits(self, texts: list) -> np.ndarray:
        """Before calibration."""
        features = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        for owners, flat, starts in pieces(texts):
            best, _ = self.pooled(flat, starts)
            np.maximum.at(features, owners, best)  # maxima of a text's pieces meet by the greater
        return (features @ self.out + self.intercept).astype(np.float64)

    def language(self, texts: list) -> np.ndarray:
        if self.of_language is None or self.of_language.shape[1] < 2:
            return np.zeros(len(texts), np.int64)
        out = np.zeros(len(texts), np.int64)
        for k, ids in enumerate(texts):
            total = np.zeros(self.of_language.shape[1])
            for start in range(0, len(ids), PIECE):
                total += self.of_language[ids[start:start + PIECE]].sum(0, dtype=np.float64)
            out[k] = total.argmax()
        return out

    def scores(self, texts: list) -> np.ndarray:
        if self.embedding is None:
            return np.zeros(len(texts))
        moved = self.logits(texts) - self.thresholds[self.language(texts)] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(moved, -40, 40)))


def pieces(texts: list):
    """(text numbers, flat ids, starts): groups of texts, each laid out between paddings; a text of more than PIECE words
    alone, padded and then cut into pieces that overlap by PAD, so that the windows of its pieces are those of the text."""
    padding = np.zeros(PAD, np.int32)
    owners, flat, starts, size = [], [], [], 0
    for k, ids in enumerate(texts):
        if len(ids) > PIECE:
            padded = np.concatenate([padding, ids, padding])
            for begin in range(0, len(padded) - PAD, PIECE):
                yield np.array([k]), padded[begin:begin + PIECE + PAD], np.array([0])
            continue
        if owners and size + len(ids) > PIECE:
            yield np.array(owners), np.concatenate([*flat, padding]), np.array(starts)
            owners, flat, starts, size = [], [], [], 0
        owners.append(k)
        starts.append(size)
        flat += [padding, ids]
        size += len(ids) + PAD
    if owners:
        yield np.array(owners), np.concatenate([*flat, padding]), np.array(starts)


def _common(counts: dict) -> list:
    """The most common languages of {language: documents}."""
    return sorted(sorted(counts, key=lambda x: (-counts[x], x))[:MOST_LANGUAGES])


def _language_table(counts: np.ndarray) -> np.ndarray:
    """Log frequencies, bucket by language, of counts by language and bucket, smoothed."""
    table = counts.T.astype(np.float32) + np.float32(0.1)
    table[0] = 1
    return np.log(table / table.sum(0)).astype(np.float32)


def _add(counts: np.ndarray, ids, y, lang, names):
    """Add a document to counts: rows 0 and 1 documents of either label with a bucket, then the words of each language."""
    counts[int(y), np.unique(ids)] += 1
    if lang in names:
        np.add.at(counts[2 + names.index(lang)], ids, 1)


def initial(uses, share_, buckets, seed=SEED, shrink=SHRINK) -> Model:
    """Word by word the shrunken log odds of the documents with it, in the first coordinate; random elsewhere."""
    draw = np.random.default_rng(seed)
    p = (uses[1] + shrink * share_) / (uses.sum(0) + shrink)
    embedding = draw.normal(0, 0.1, (buckets, DIMENSIONS)).astype(np.float32)
    embedding[:, 0] = np.log(p / (1 - p)) - np.log(share_ / (1 - share_))
    embedding[0] = 0
    filters = []
    for w in WIDTHS:
        f = draw.normal(0, 0.3, (w * DIMENSIONS, FILTERS)).astype(np.float32)
        f[::DIMENSIONS] = np.abs(draw.normal(1 / w, 0.3, (w, FILTERS)))
        filters.append(f)
    return Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1, np.float32), float(np.log(share_ / (1 - share_))) - 1.0)


class _Adam:
    def __init__(self, values, rate):
        self.values, self.rate, self.m, self.v, self.t = values, rate, [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0

    def step(self, grads):
        self.t += 1
        for x, g, m, v in zip(self.values, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


class Learner:
    """A model and the state of its steps: the dense parameters step by Adam, embeddings by Adagrad at the words that won."""

    def __init__(self, model: Model, rate=RATE, decay=DECAY):
        self.model, self.rate, self.decay = model, rate, decay
        self.dense = _Adam([*model.filters, *model.bias, model.out], rate)
        self.spread = np.full(len(model.embedding), 1e-3, np.float32)

    def winners(self, texts: list) -> tuple:
        """Of each text, for each width, the best scores by filter and the words of their windows."""
        best = [np.full((len(texts), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        window = [np.zeros((len(texts), FILTERS, w), np.int32) for w in WIDTHS]
        for owners, flat, starts in pieces(texts):
            _, won = self.model.pooled(flat, starts)
            for n, (w, (scores, tops)) in enumerate(zip(WIDTHS, won)):
                ends = np.append(starts[1:], len(scores))
                where = np.array([s + scores[s:e].argmax(0) for s, e in zip(starts, ends)])
                better = tops > best[n][owners]  # of a long text's pieces the first with the greatest
                best[n][owners] = np.where(better, tops, best[n][owners])
                window[n][owners] = np.where(better[:, :, None], flat[where[:, :, None] + np.arange(w)], window[n][owners])
        return best, window

    def step(self, texts: list, labels: np.ndarray):
        model = self.model
        best, windows = self.winners(texts)
        z = np.concatenate([np.maximum(b + bias, 0) for b, bias in zip(best, model.bias)], 1)
        p = 1 / (1 + np.exp(-(z @ model.out + model.intercept)))
        error = ((p - labels) / len(labels)).astype(np.float32)
        grad_z = error[:, None] * model.out * (z > 0)
        grads_f, grads_b, words, moves = [], [], [], []
        for n, (w, filters, window) in enumerate(zip(WIDTHS, model.filters, windows)):
            g = grad_z[:, n * FILTERS:(n + 1) * FILTERS]
            vectors = model.embedding[window].reshape(*window.shape[:2], w * DIMENSIONS)
            grads_f.append(np.einsum("df,dfx->xf", g, vectors) + self.decay * filters)
            grads_b.append(g.sum(0))
            words.append(window.ravel())
            moves.append((g[:, :, None] * filters.T[None]).reshape(-1, DIMENSIONS))
        grad_out = error @ z + self.decay * model.out
        used, inverse = np.unique(np.concatenate(words), return_inverse=True)
        grad_e = np.zeros((len(used), DIMENSIONS), np.float32)
        np.add.at(grad_e, inverse, np.concatenate(moves))
        self.spread[used] += (grad_e * grad_e).mean(1)
        model.embedding[used] -= (10 * self.rate * grad_e / np.sqrt(self.spread[used])[:, None]) * (used != 0)[:, None]
        self.dense.step([*grads_f, *grads_b, grad_out])
        model.intercept -= 10 * self.rate * float(error.sum())
        return used

    def small(self) -> list:
        """All that is not by word, to be averaged."""
        return [*self.dense.values, *self.dense.m, *self.dense.v, np.array([self.model.intercept, self.dense.t])]

    def take(self, values: list):
        for mine, value in zip([*self.dense.values, *self.dense.m, *self.dense.v], values):
            mine[...] = value
        self.model.intercept, self.dense.t = float(values[-1][0]), float(values[-1][1])


def train(texts: list, labels: np.ndarray, buckets=BUCKETS, epochs=EPOCHS, batch=BATCH, rate=RATE, decay=DECAY, seed=SEED) -> Model:
    """Mini-batches of a list in seeded order."""
    counts = np.zeros((2, buckets))
    for ids, y in zip(texts, labels):
        _add(counts, ids, y, None, ())
    learner, draw = Learner(initial(counts, labels.mean(), buckets, seed), rate, decay), np.random.default_rng(seed + 1)
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for begin in range(0, len(order), batch):
            at = order[begin:begin + batch]
            learner.step([texts[k] for k in at], labels[at])
    return learner.model


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among those between scores with the best F1; without both classes, 0."""
    x, at = np.unique(logits, return_inverse=True)
    return _threshold(x, np.bincount(at, labels, len(x)), np.bincount(at, 1 - labels, len(x)))


def _threshold(x, hits, others) -> float:
    """The same of ascending scores with the number of either label at each."""
    if not hits.sum() or not others.sum() or len(x) < 2:
        return 0.0
    # A threshold between k - 1 and k marks all from k on.
    above, marked = hits[::-1].cumsum()[::-1][1:], (hits + others)[::-1].cumsum()[::-1][1:]
    f1 = 2 * above / (marked + hits.sum())
    k = int(np.lexsort((x[1:] - x[:-1], f1 >= f1.max() - 1e-12))[-1])
    return float((x[k] + x[k + 1]) / 2)


def _grid(logits) -> np.ndarray:
    """Numbers of the steps of 1/GRID that logits lie in; those beyond WIDEST count with the outermost."""
    return np.clip(np.floor(np.asarray(logits) * GRID), -WIDEST * GRID, WIDEST * GRID - 1).astype(np.int64) + WIDEST * GRID


def _thresholds(counts, least) -> np.ndarray:
    """By language, of counts by language, label and step."""
    def of(c):
        at = np.flatnonzero(c.sum(0))
        return _threshold((at + 0.5) / GRID - WIDEST, c[1, at], c[0, at])
    return np.array([of(c if c[1].sum() >= least else counts.sum(0)) for c in counts])


def fit_model(texts: list, labels, langs: list, kept_back, buckets=BUCKETS, least=LEAST, **training) -> Model:
    """A calibrated model of lists: word buckets, 0/1 labels and languages; `kept_back` marks the documents for thresholds."""
    labels, kept_back = np.asarray(labels, np.float64), np.asarray(kept_back, bool)
    if not labels.any() or labels.all():
        return Model()
    if not (labels[~kept_back].any() and (1 - labels[~kept_back]).any()):
        kept_back = np.zeros(len(texts), bool)  # too few to keep any back
    learned = np.flatnonzero(~kept_back)
    model = train([texts[k] for k in learned], labels[learned], buckets, **training)
    model.languages = _common(Counter(langs[k] for k in learned))
    counts = np.zeros((2 + len(model.languages), buckets), np.int64)
    for k in learned:
        _add(counts, texts[k], labels[k], langs[k], model.languages)
    model.of_language = _language_table(counts[2:])
    # Few documents kept back tell little: then those learned from speak, too.
    speak = np.flatnonzero(kept_back) if labels[kept_back].sum() >= least else np.arange(len(texts))
    model.thresholds = _thresholds(_scored(model, [texts[k] for k in speak], labels[speak]), least)
    return model


def _scored(model: Model, texts: list, labels) -> np.ndarray:
    """Counts of texts by language, label and step of the logit."""
    counts = np.zeros((max(1, len(model.languages)), 2, 2 * WIDEST * GRID), np.int64)
    np.add.at(counts, (model.language(texts), np.asarray(labels, np.int64), _grid(model.logits(texts))), 1)
    return counts


def held_out(id_col):
    """The contract's rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def summed(rows: DataFrame, of_batches, shape) -> np.ndarray:
    """The sum over all tasks of the integer arrays that `of_batches(batches)` gives, row by row in FAN tasks."""
    def one(batches):
        yield _packed(enumerate(of_batches(batches)))

    def joined(batches):
        sums = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.frombuffer(v.as_buffer(), np.int64)
                sums[k] = sums[k] + v if k in sums else v
        yield _packed(sums.items())

    out = np.zeros((shape[0], int(np.prod(shape[1:]))), np.int64)
    for r in rows.mapInArrow(one, "k int, v binary").repartition(FAN, "k").mapInArrow(joined, "k int, v binary").collect():
        out[r.k] = np.frombuffer(r.v, np.int64)
    return out.reshape(shape)


def _packed(rows):
    rows = [(k, np.ascontiguousarray(v).tobytes()) for k, v in rows]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["k", "v"])


def _documents(batch):
    """(word buckets, label, language) of a batch of the written shards."""
    ids = [np.frombuffer(v.as_buffer(), np.int32) for v in batch.column("ids")]
    return ids, batch.column("y").to_numpy(zero_copy_only=False), batch.column("lang").to_pylist()


def passes(n, epochs=EPOCHS) -> int:
    """How often training sees each of n documents: a divisor of ROUNDS."""
    wanted = max(1.0, epochs * min(1.0, MANY / max(1, n)))
    return max(k for k in range(1, ROUNDS + 1) if ROUNDS % k == 0 and k <= wanted)


def _round(rows: DataFrame, learner: Learner, batch) -> None:
    """Every task trains a copy on its rows; the learner becomes their average, each word's over the tasks that moved it."""
    spark = rows.sparkSession
    sent, buckets = share(spark, learner), len(learner.spread)
    edges = np.linspace(0, buckets, FAN + 1).astype(np.int64)

    def trained(batches):
        mine, start, moved, n = None, None, np.zeros(buckets, bool), 0
        for found in batches:
            if mine is None:
                mine, start = shared(sent), shared(sent)
            ids, labels, _ = _documents(found)
            for begin in range(0, len(ids), batch):
                moved[mine.step(ids[begin:begin + batch], labels[begin:begin + batch].astype(np.float64))] = True
            n += len(ids)
        if mine is None:
            return
        at = np.flatnonzero(moved).astype(np.int32)
        values = np.c_[mine.model.embedding[at] - start.model.embedding[at], mine.spread[at] - start.spread[at]].astype(np.float32)
        cuts = np.searchsorted(at, edges)
        parts = [(k, at[cuts[k]:cuts[k + 1]], values[cuts[k]:cuts[k + 1]]) for k in range(FAN)]
        small = np.concatenate([np.ravel(v).astype(np.float64) for v in mine.small()]) * n
        yield _moves([*parts, (FAN, np.array([n], np.int32), small)])

    def averaged(batches):
        # Addition goes in the order of the values, so that reruns agree whatever task comes first.
        got = {}
        for found in batches:
            for k, at, v in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), found.column(2).to_pylist()):
                got.setdefault(k, []).append((at, v))
        for k, parts in got.items():
            parts.sort()
            if k == FAN:
                n = sum(int(np.frombuffer(at, np.int32)[0]) for at, _ in parts)
                yield _moves([(k, np.zeros(0, np.int32), sum(np.frombuffer(v) for _, v in parts) / n)])
                continue
            total, times = np.zeros((edges[k + 1] - edges[k], DIMENSIONS + 1)), np.zeros(edges[k + 1] - edges[k])
            for at, v in parts:
                at = np.frombuffer(at, np.int32) - edges[k]
                total[at] += np.frombuffer(v, np.float32).reshape(-1, DIMENSIONS + 1)
                times[at] += 1
            at = np.flatnonzero(times)
            yield _moves([(k, (at + edges[k]).astype(np.int32), (total[at] / times[at, None]).astype(np.float32))])

    schema = "k int, at binary, v binary"
    for r in rows.mapInArrow(trained, schema).repartition(FAN, "k").mapInArrow(averaged, schema).collect():
        if r.k == FAN:
            flat, values = np.frombuffer(r.v), []
            for old in learner.small():
                values.append(flat[:old.size].reshape(old.shape))
                flat = flat[old.size:]
            learner.take(values)
            continue
        at, v = np.frombuffer(r.at, np.int32), np.frombuffer(r.v, np.float32).reshape(-1, DIMENSIONS + 1)
        learner.model.embedding[at] += v[:, :-1]
        learner.spread[at] += v[:, -1]
    sent.unpersist()


def _moves(rows):
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), *[pa.array([np.ascontiguousarray(r[c]).tobytes() for r in rows], pa.binary()) for c in (1, 2)]],
                                      names=["k", "at", "v"])


def shards(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", label_col="toxic", buckets=BUCKETS, calibrate=CALIBRATE) -> DataFrame:
    """(h, y, lang, back, ids): every labelled row that is not held out with the buckets of its whole text, written once."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).filter(~held_out("id")).withColumn("h", F.xxhash64(F.lit(SEED), "id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    back = F.pmod(F.shiftright("h", 8), F.lit(1000)) < 1000 * calibrate
    count = known.count()
    # Counted labels up to a bound go to the texts; beyond it texts and labels meet by id.
    rows = rows.join(F.broadcast(known) if count <= BROADCAST_ROWS else known, "id").select("h", "y", "lang", back.alias("back"), "text")

    def ids_of(batches):
        cache = WordHashes()
        for batch in batches:
            found = word_ids(batch.column(4).to_pylist(), cache, buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x.tobytes() for x in found], pa.binary())], names=["h", "y", "lang", "back", "ids"])

    n = -(-count // SHARD_DOCS) or 1
    dealt = rows.mapInArrow(ids_of, "h long, y int, lang string, back boolean, ids binary").repartition(n, "h")
    return materialize(dealt.sortWithinPartitions("h", "ids"), "toxicity-shards")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", label_col="toxic", buckets=BUCKETS,
        calibrate=CALIBRATE, least=LEAST, epochs=EPOCHS, batch=BATCH, rate=RATE, decay=DECAY, seed=SEED) -> Model:
    """A model of all labelled documents that are not held out."""
    spark = settle(docs.sparkSession)
    rows = shards(docs, labels, id_col, text_col, lang_col, label_col, buckets, calibrate)
    sizes = {(r.back, r.y): r["count"] for r in rows.groupBy("back", "y").count().collect()}
    of = lambda y, *backs: sum(sizes.get((b, y), 0) for b in backs)
    if not of(0, True, False) or not of(1, True, False):
        return Model()
    none_back = not (of(0, False) and of(1, False))  # too few to keep any back
    learned = rows if none_back else rows.filter("not back")
    backs = (True, False) if none_back else (False,)
    common = learned.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    names = _common({r.lang: r["count"] for r in common})

    def counted(batches):
        counts = np.zeros((2 + len(names), buckets), np.int64)
        for found in batches:
            for ids, y, lang in zip(*_documents(found)):
                _add(counts, ids, y, lang, names)
        return counts

    counts = summed(learned.select("ids", "y", "lang"), counted, (2 + len(names), buckets))
    n = of(0, *backs) + of(1, *backs)
    learner = Learner(initial(counts[:2], of(1, *backs) / n, buckets, seed), rate, decay)
    slices = ROUNDS // passes(n, epochs)
    for k in range(ROUNDS):
        _round(learned.filter(F.pmod(F.shiftright("h", 20), F.lit(slices)) == k % slices).select("ids", "y", "lang"), learner, batch)
    model = learner.model
    model.languages, model.of_language = names, _language_table(counts[2:])
    sent = share(spark, model)

    def scored(batches):
        m = shared(sent)
        counts = np.zeros((max(1, len(names)), 2, 2 * WIDEST * GRID), np.int64)
        for found in batches:
            ids, labels, _ = _documents(found)
            counts += _scored(m, ids, labels)
        return counts

    # Few documents kept back tell little: then those learned from speak, too.
    speak = rows if none_back or of(1, True) < least else rows.filter("back")
    model.thresholds = _thresholds(summed(speak.select("ids", "y", "lang"), scored, (max(1, len(names)), 2, 2 * WIDEST * GRID)), least)
    return model


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", label_col="toxic", buckets=BUCKETS, **fitting) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (score >= 0.7) of every whole text."""
    spark = settle(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, lang_col, label_col, buckets, **fitting)
    sent = share(spark, model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        m = shared(sent)
        cache = WordHashes()
        for batch in batches:
            texts = word_ids(batch.column(1).to_pylist(), cache, buckets)
            found = m.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    found = rows.mapInArrow(run, StructType([rows.schema["id"], StructField("score", DoubleType())]))
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
