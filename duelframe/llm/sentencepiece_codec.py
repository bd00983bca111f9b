"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of scored pieces.

The best segmentation of a text is that of its chunks (see `pieces`); each task solves the distinct chunks of a batch
together and keeps solved ones while they fit. Characters no piece covers become byte pieces. Spaces become markers, one
marker stands before the text, and decoding turns markers back and drops that first space.

Defined results: a null or empty text has no pieces and score 0; a marker character in the text itself decodes as a
space; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

import re
from array import array
from typing import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, share, shared
from .pieces import MARK, Pieces, marked

MODEL = "piece_bpe_32k.model"


class Encoder:
    """Solved chunks in two generations: when the newer one is full it becomes the older one, and what is used again moves
    back, so that common chunks stay. Ids (as bytes) and scores are plain values, which the garbage collector passes by."""

    def __init__(self, pieces: Pieces, limit: int = 60_000):
        self.pieces, self.limit = pieces, limit
        self.chunks = re.compile(pieces.chunk_pattern)
        self.known, self.scores = {}, {}
        self.older: tuple = ({}, {})

    def _learn(self, new: list):
        """Solve new chunks in groups of bounded length."""
        at = 0
        while at < len(new):
            size, stop = 0, at
            while stop < len(new) and (stop == at or size + len(new[stop]) <= 1 << 16):
                size += len(new[stop])
                stop += 1
            ids, offsets, scores = self.pieces.lattice(new[at:stop]).best()
            flat, offsets = ids.astype(np.int32).tobytes(), (4 * offsets).tolist()
            group = new[at:stop]
            self.known.update(zip(group, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]))
            self.scores.update(zip(group, scores.tolist()))
            at = stop

    def encode(self, texts: list) -> list:
        """(array of ids, score) for each text."""
        cut = [self.chunks.findall(marked(t)) for t in texts]
        if len(self.known) > self.limit:
            self.older, self.known, self.scores = (self.known, self.scores), {}, {}
        wanted = set().union(*cut).difference(self.known) if cut else set()
        ids, scores = self.older
        again = wanted.intersection(ids)
        self.known.update(zip(again, map(ids.__getitem__, again)))
        self.scores.update(zip(again, map(scores.__getitem__, again)))
        self._learn(sorted(wanted.difference(again), key=len))
        ids, scores = self.known.__getitem__, self.scores.__getitem__
        return [(array("i", b"".join(map(ids, chunks))), sum(map(scores, chunks), 0.0)) for chunks in cut]


def decode(pieces: Pieces, ids) -> str:
    text = b"".join(map(pieces.decoded.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def load(model_file: str | None = None) -> Pieces:
    return Pieces.load(model_file or public_tokenizers.path(MODEL))


def encode(docs: DataFrame, pieces: Pieces, id_col="doc_id", text_col="text") -> DataFrame:
    """id, ids, n_tokens, n_byte_tokens, score, round_trip (does decoding give the text back) of every text."""
    spark = settle(docs.sparkSession)
    sent = share(spark, pieces)  # as large as the vocabulary

    def run(batches):
        known = shared(sent)
        encoder = Encoder(known)
        is_byte = np.zeros(len(known.surfaces), bool)
        is_byte[list(known.byte_ids.values())] = True
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = encoder.encode(texts)
            flat = np.frombuffer(b"".join(ids.tobytes() for ids, _ in found), np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in found])])
            byte_sums = np.concatenate([[0], np.cumsum(is_byte[flat])])
            good = [decode(known, ids) == t.replace(MARK, " ") for (ids, _), t in zip(found, texts)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(np.diff(offsets)),
                pa.array(byte_sums[offsets[1:]] - byte_sums[offsets[:-1]]), pa.array([s for _, s in found], pa.float64()), pa.array(good, pa.bool_()),
            ], names=["id", "ids", "n_tokens", "n_byte_tokens", "score", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded = rows.mapInArrow(run, "id long, ids array<int>, n_tokens long, n_byte_tokens long, score double, round_trip boolean")
    return coded.withColumnRenamed("id", id_col)


def decode_column(coded: DataFrame, pieces: Pieces, ids_col="ids", to="text") -> DataFrame:
    """`coded` with the decoded text as one more column (it must not have one of that name); null ids give null."""
    if to in coded.columns:
        raise ValueError(f"column {to} is there already")
    sent = share(settle(coded.sparkSession), pieces)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared(sent)
        for part in parts:
            yield pd.Series([None if ids is None else decode(known, ids) for ids in part], dtype=object)

    return coded.withColumn(to, F.pandas_udf(run, "string")(F.col(ids_col)))
