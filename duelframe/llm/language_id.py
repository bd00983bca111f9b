"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary; a text's likelihood is the sum, over all its
segmentations into pieces, of the product of their probabilities, computed by the forward algorithm. Probabilities are
fitted by expectation-maximisation on word counts of at most `fit_docs` labelled documents per language (a documented
bound; the counts and expectations are Spark jobs, the driver sees one number per piece and language). Prediction reads
every whole text.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if nothing was learned; rows
without id or language teach nothing; a null id is not held out; of equal likelihoods the first language by code point
wins; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duelframe.session import materialize

from .common import settle, share, shared
from .pieces import Pieces, marked

MODEL = "piece_bpe_32k.model"
FIT_DOCS, ROUNDS, MAX_LANGUAGES = 2048, 3, 1000
_SPLITS = 64
WORDLIKE, LATIN = re.compile(r"[^\W\d_]"), re.compile(r"[A-Za-z]")


def held_out(id_col="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_sample(docs: DataFrame, id_col, text_col, lang_col, fit_docs) -> DataFrame:
    """At most `fit_docs` labelled documents of each language, by hash; every language is cut in 64 so that no task ranks a
    language alone. (lang, text)"""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    ranked = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"))
    split = F.pmod(F.col("h"), F.lit(_SPLITS))
    order = Window.partitionBy("lang", split).orderBy("h", "id")
    chosen = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(1, fit_docs // _SPLITS)).select("lang", "id").distinct()
    chosen = materialize(chosen, "lang-sample")
    if chosen.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # At most fit_docs ids for each of at most MAX_LANGUAGES languages: bounded, whatever the input.
    texts = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("lang", "text")


def _count_chunks(pattern):
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            cut = re.compile(pattern)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((lang, chunk) for chunk in cut.findall(marked(text)))
            if counts:
                langs, chunks = zip(*counts)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(chunks), pa.array(list(counts.values()), pa.int64())], names=["lang", "chunk", "n"])
    return run


def _log(pieces: Pieces, probabilities: np.ndarray):
    """Log probabilities of pieces by language (rows: pieces), and of a character spelled by its bytes."""
    log = np.log(probabilities)
    of_byte = np.zeros((256, log.shape[1]))
    for byte in range(256):
        of_byte[byte] = log[pieces.byte_ids[byte]] if byte in pieces.byte_ids else log[pieces.unknown]
    return log, of_byte


def _edge_logs(lattice, begin, ids, log, of_byte):
    out = log[ids]
    bare = np.nonzero(ids < 0)[0]
    if len(bare):
        points, inverse = np.unique(lattice.uncovered(begin[bare]), return_inverse=True)
        spelled = np.array([of_byte[list(chr(c).encode("utf-8", "surrogatepass"))].sum(0) for c in points.tolist()])
        out[bare] = spelled[inverse]
    return out


def forward(pieces: Pieces, chunks: list, log, of_byte) -> np.ndarray:
    """Log likelihood of each chunk (rows) in each language (columns), over all segmentations."""
    lattice = pieces.lattice(chunks)
    alpha = np.full((lattice.nodes, log.shape[1]), -np.inf)
    alpha[lattice.first] = 0.0
    for begin, end, ids in lattice.steps():
        alpha[end] = np.logaddexp(alpha[end], alpha[begin] + _edge_logs(lattice, begin, ids, log, of_byte))
    return alpha[lattice.final]


def expected(pieces: Pieces, chunks: list, weights: np.ndarray, log, of_byte) -> dict:
    """Expected uses of each piece under each language: weights (chunks x languages) times posterior, by forward-backward."""
    lattice = pieces.lattice(chunks)
    steps = [(b, e, i, _edge_logs(lattice, b, i, log, of_byte)) for b, e, i in lattice.steps()]
    alpha = np.full((lattice.nodes, log.shape[1]), -np.inf)
    alpha[lattice.first] = 0.0
    for begin, end, _, logs in steps:
        alpha[end] = np.logaddexp(alpha[end], alpha[begin] + logs)
    beta = np.full_like(alpha, -np.inf)
    beta[lattice.final] = np.log(np.maximum(weights, 1e-300)) - alpha[lattice.final]
    total = np.zeros((len(log), log.shape[1]))
    for begin, end, ids, logs in reversed(steps):
        back = beta[end] + logs
        known = ids >= 0
        np.add.at(total, ids[known], np.exp(alpha[begin] + back)[known])
        # One start has several ends, and each end of a step is met once: fold them one length at a time.
        length = end - begin
        for size in np.unique(length).tolist():
            at = length == size
            beta[begin[at]] = np.logaddexp(beta[begin[at]], back[at])
    return total


def fit(docs: DataFrame, pieces: Pieces, id_col="doc_id", text_col="text", lang_col="lang", fit_docs=FIT_DOCS, rounds=ROUNDS, add=0.01):
    """(languages, piece probabilities: pieces x languages). Held-out documents teach nothing."""
    spark = settle(docs.sparkSession)
    sample = fit_sample(docs, id_col, text_col, lang_col, fit_docs)
    counts = sample.mapInArrow(_count_chunks(pieces.chunk_pattern), "lang string, chunk string, n long")
    counts = materialize(counts.groupBy("lang", "chunk").agg(F.sum("n").alias("n")), "lang-counts")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not languages:
        return [], None
    place = {lang: k for k, lang in enumerate(languages)}
    sent = share(spark, pieces)  # as large as the vocabulary
    start = np.exp(pieces.scores - pieces.scores.max())
    start[list(pieces.byte_ids.values())] = start.min()
    probabilities = np.repeat((start / start.sum())[:, None], len(languages), axis=1)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(probabilities)  # pieces x languages

        def expect(batches):
            p = shared(sent)
            log, of_byte = _log(p, now.value)
            total = np.zeros_like(log)
            for batch in batches:
                lang, chunk, n = (batch.column(c).to_pylist() for c in range(3))
                order = sorted(range(len(chunk)), key=lambda r: len(chunk[r]))
                for at in range(0, len(order), 4000):
                    rows = order[at:at + 4000]
                    weights = np.zeros((len(rows), log.shape[1]))
                    weights[np.arange(len(rows)), [place[lang[r]] for r in rows]] = [n[r] for r in rows]
                    total += expected(p, [chunk[r] for r in rows], weights, log, of_byte)
            piece, language = np.nonzero(total > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(language, pa.int32()), pa.array(total[piece, language])], names=["piece", "language", "uses"])

        uses = counts.mapInArrow(expect, "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses"))
        found = uses.toPandas()  # at most a row for each piece and language
        probabilities = np.full_like(probabilities, add)
        probabilities[found["piece"], found["language"]] += found["uses"]
        probabilities /= probabilities.sum(0)
    return languages, probabilities


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numerals such as a fraction or a Roman one are none, though they are word-like."""
    return LATIN.search(text) is not None or any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def predict(docs: DataFrame, pieces: Pieces, languages: list, probabilities, id_col="doc_id", text_col="text", columns=(), limit=100_000) -> DataFrame:
    """id, `columns`, lang_pred and score (posterior of the prediction under equal priors) of every whole text."""
    spark = settle(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *columns)
    if not languages:
        return rows.drop("text").withColumnRenamed("id", id_col).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    sent = share(spark, (pieces, probabilities))

    def run(batches):
        p, chances = shared(sent)
        log, of_byte = _log(p, chances)
        cut = re.compile(p.chunk_pattern)
        known: dict = {}
        logs = np.empty((0, len(languages)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lettered = [t is not None and has_letter(t) for t in texts]
            chunked = [cut.findall(marked(t)) if ok else [] for t, ok in zip(texts, lettered)]
            if len(known) > limit:
                known, logs = {}, logs[:0]
            new = sorted(set().union(*chunked).difference(known), key=lambda c: (len(c), c)) if chunked else []
            at, more = 0, [logs]
            while at < len(new):
                size, stop = 0, at
                while stop < len(new) and (stop == at or size + len(new[stop]) <= 1 << 16):
                    size += len(new[stop])
                    stop += 1
                more.append(forward(p, new[at:stop], log, of_byte))
                at = stop
            logs = np.concatenate(more)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            names, scores = [], []
            for chunks, ok in zip(chunked, lettered):
                if not ok:
                    names.append("und")
                    scores.append(0.0)
                    continue
                total = logs[np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))].sum(0)
                best = int(total.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]],
                                             names=["id", "lang_pred", "score", *batch.schema.names[2:]])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    out = StructType([rows.schema["id"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), *rows.schema.fields[2:]])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def load(model_file: str | None = None) -> Pieces:
    return Pieces.load(model_file or public_tokenizers.path(MODEL))


def identify(docs: DataFrame, pieces: Pieces | None = None, id_col="doc_id", text_col="text", lang_col="lang", **fitting) -> DataFrame:
    """Fit on the documents that are not held out and predict all: id, held_out, lang_pred, score."""
    pieces = pieces or load()
    languages, probabilities = fit(docs, pieces, id_col, text_col, lang_col, **fitting)
    found = predict(docs, pieces, languages, probabilities, id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, pieces: Pieces | None = None, id_col="doc_id", text_col="text", lang_col="lang", least=0.5, **fitting) -> DataFrame:
    """The documents whose language is known with a posterior of at least `least`, whole and in their own columns."""
    pieces = pieces or load()
    languages, probabilities = fit(docs, pieces, id_col, text_col, lang_col, **fitting)
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = predict(whole, pieces, languages, probabilities, "_id", "_text", ["row"])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
