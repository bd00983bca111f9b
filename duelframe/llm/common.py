"""What the operators share: session settings, word and hash helpers, clash-free rows."""

import sys

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.session import tune

# A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_CONF = {
    # Long texts: batches to Python are bounded by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Shuffle files of a finished write go at once; nothing here reads a plan's shuffle twice.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


# Functions sent to executors carry their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["duelframe.llm"])


def settle(spark: SparkSession) -> SparkSession:
    tune(spark)
    for key, value in _CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def share(spark: SparkSession, value):
    """A broadcast of an object of this package; its class travels with it. The caller vouches for its size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast):
    return cloudpickle.loads(broadcast.value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


class WordHashes(dict):
    """64-bit hashes of words, kept while they fit; `limit` bounds the memory, not the result."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def spread(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the `size`-word shingles, sorted; a shorter sequence is one shingle, none gives none."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    mixed = spread(words[:count] + np.uint64(size))
    for k in range(1, size):
        mixed = spread(mixed * np.uint64(3) + words[k:k + count])
    return np.unique(mixed)
