"""A corpus pipeline of five stages, each applying one operator of `duelframe.llm` to all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of `documents`; the last returns pieces. `run` writes every
stage's rows to the shared folder and rereads them, so a lost executor costs at most the running stage.
"""

from pyspark.sql import DataFrame, SparkSession

from duelframe.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_codec
from duelframe.llm.common import settle
from duelframe.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or with an even posterior go."""
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest id, of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each connected group of five-word shingle sets 0.8 alike."""
    return near_dedup.keep_one(docs, size=5, orders=2)  # the last step finds what cheap rounds leave


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most three times."""
    return mixing.apply_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document's whole text."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# Language models and segmentations are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = settle(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
