"""From raw documents to packed training sequences: five stages, each reading what the one before kept.

Reject documents of low quality, keep one of each group of near-duplicates, redact personal data, mix the sources to
their target weights, pack the result into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytoloom.llm import mixing, ngram_join, packing, pii, quality
from cytoloom.scratch import materialise


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more; null and empty texts are scored as texts without words, repeated rows stay or go together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles with a similarity of 0.8 or more; texts without words are in no group."""
    return ngram_join.one_of_each(docs, words=5, similarity=(80, 100))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; null texts stay null, repeated rows give equal rows."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one of its own."""
    return mixing.mixed_corpus(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its sequence; null and empty texts are their end mark alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: Shingle joins, seeded rounding and bin completion have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
