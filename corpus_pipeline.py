"""From raw documents to token ids: the stages of a training-data pipeline, each on what the one before it kept.

    python corpus_pipeline.py SF_DIR OUT_DIR

runs them with every stage written and read again.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from ringloom.llm import mixing, pieces, quality, secrets, shingles
from ringloom.llm.common import settle


#: Words in a shingle, and the least Jaccard similarity of near-duplicates in 100. op10 alone, with its defaults, is held to other ones.
WIDTH, LEAST = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return quality.filtered(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return shingles.one_of_each(docs, WIDTH, LEAST)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder where a text had a secret."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes of ids and of the text that they decode to, and the ids, for each copy of each document."""
    return pieces.digests(pieces.encode(docs), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", jaccard_join),
    ("secret_scans", secret_scans),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Near-duplicate groups and piece segmentation have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


if __name__ == "__main__":
    session = SparkSession.builder.appName("corpus-pipeline").getOrCreate()
    run(session, sys.argv[1]).write.parquet(sys.argv[2])
