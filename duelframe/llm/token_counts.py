"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its file and of the settings of
the count. Counts stored under both digests are joined; of the texts without one, each distinct text is encoded once,
and its count is appended to the cache. The cache is a Parquet table in a shared folder; an append is one committed
write, so a lost executor or a failed job leaves the earlier counts as they were, and a digest appended twice (by two
runs at once) carries the same count twice and is read once.

The library tokenizes a text in stretches that no token crosses; a stretch begins before a plain space that follows a
visible character. Counts of such stretches are kept in a task while they fit.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; special strings inside texts are handled as the
tokenizer does by default; repeated rows give repeated results; an empty table gives an empty result and leaves the cache
as it was; other columns are not read.
"""

import hashlib
import os
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.session import materialize, new_path

from .common import settle, text_or_empty

MODEL, LIMIT = "byte_bpe_50k.json", 1024
# A stretch ends where a plain space follows a visible character.
CUT = re.compile(r"(?<=\S)(?= )")
_SCHEMA = "version string, digest binary, n_tokens long"


def version_of(model_file: str) -> str:
    with open(model_file, "rb") as f:
        return hashlib.sha256(f.read() + b"|add_special_tokens=False|truncation=None|padding=None").hexdigest()


class Counter:
    """Counts tokens of texts with the library, a stretch at a time."""

    def __init__(self, model: bytes, limit: int = 100_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit, self.known = limit, {"": 0}

    def _encode(self, texts: list) -> list:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list) -> list:
        cut = [CUT.split(t) for t in texts]
        if len(self.known) > self.limit:
            self.known = {"": 0}
        new = sorted(set().union(*cut).difference(self.known)) if cut else []
        for at in range(0, len(new), 20_000):
            group = new[at:at + 20_000]
            self.known.update(zip(group, self._encode(group)))
        return [sum(map(self.known.__getitem__, parts)) for parts in cut]


def _count(model):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.count(batch.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])
    return run


def read_cache(spark, cache: str) -> DataFrame:
    """The stored counts; none if nothing was stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(_SCHEMA).parquet(cache)
    return spark.createDataFrame([], _SCHEMA)


def count_tokens(docs: DataFrame, model_file: str | None = None, cache: str | None = None, limit=LIMIT, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every document. `cache` is the folder of the stored counts, by default a new one
    in the shared folder; it must not be one of a single machine."""
    spark = settle(docs.sparkSession)
    model_file = model_file or public_tokenizers.path(MODEL)
    version, cache = version_of(model_file), cache or new_path(spark, "token-cache")
    body = text_or_empty(text_col)
    digest = F.unhex(F.sha2(body, 256))
    keys = materialize(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.octet_length(body).cast("long").alias("n_bytes")), "tokens-keys")
    stored = read_cache(spark, cache).filter(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    with open(model_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # as large as the vocabulary
    # Copies meet in the reading tasks first; each distinct text moves once and is encoded once if its digest is new.
    texts = docs.select(digest.alias("digest"), body.alias("body")).groupBy("digest").agg(F.any_value("body").alias("body"))
    misses = texts.join(stored, "digest", "left_anti").mapInArrow(_count(model), "digest binary, n_tokens long")
    misses.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    counts = materialize(counts, "tokens-counts")
    found = keys.join(counts, "digest", "left")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
