"""Corpus pipeline: quality rules, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a table
that is written as Parquet and read again as the next stage's docs. All but the last return the columns
of the documents they were given; where a stage changes `text`, `n_chars` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, packing, repetition, secrets_link, suffix_dedup
from tidemark.llm.queries import WORD_BPE, documents
from tidemark.scale import cut


def _recounted(docs: DataFrame) -> DataFrame:
    """`n_chars` as the length of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect: the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings of 200 bytes cover."""
    return _recounted(suffix_dedup.remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return _recounted(secrets_link.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequences and places."""
    # the executor holds the other stages' memory as well: small portions, fewer words remembered
    return packing.pack_documents(docs, WORD_BPE, kept=100_000, portion=2 << 20)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packed),
]
ORACLE_SQL = None  # suffix sorting and packing have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every result but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
