"""The corpus pipeline: toxicity, n-gram Jaccard join, substring dedup, mixing, BPE.

Each stage reads its predecessor's Parquet output and returns the columns of
``documents`` (the last one: the encoded corpus).  Stages keep every clean
document: only toxic documents, and all but one of each group of near
duplicates, go; repeated passages are cut out of texts; mixing repeats or leaves
out documents by the sources' rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.ship import ship
from netloom.llm import bpe, mixing, ngram_join, substring_dedup, toxicity
from netloom.llm.queries import MIX_WEIGHTS
from netloom.functions.store import stored, table

LEARN_FOLD = 5


def _learns(doc_id: Column) -> Column:
    return toxicity.remainder(doc_id, LEARN_FOLD) != 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), _learns(F.col("doc_id")))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with word-5-gram Jaccard of 0.8 or more, the smallest id."""
    ship(spark)
    return ngram_join.first_of_each(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that started earlier."""
    ship(spark)
    return substring_dedup.removed(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mix(docs, MIX_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digests of the ids and of the decoded text."""
    ship(spark)
    outputs = {x: x for x in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")}
    return bpe.encoded(docs.select("doc_id", "source", "text"), bpe.default_path(), outputs).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first, second, third and last stage have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
