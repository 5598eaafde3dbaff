"""The registered queries of this subpackage: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bytebpe, collocations, exact_dedup, jaccard_join, license_scan, order_minhash, packing, repetition
from tidemark.llm import sanitise, secrets_link, suffix_dedup, url_filter, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")  # the ranks of byte_bpe_50k.tiktoken as a tokenizer file
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("op1_jaccard_join", jaccard_join.oracle_sql())
def op1_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf))


@query("op2_order_minhash")
def op2_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return order_minhash.compare_with_edited(documents(spark, sf))


@query("op3_url_filter")
def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf))


@query("op5_sanitise")
def op5_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    return sanitise.digests(documents(spark, sf))


@query("op6_repetition_rules")
def op6_repetition_rules(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.rules(documents(spark, sf))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets_link.digests(documents(spark, sf))


@query("op8_license_scan", license_scan.oracle_sql())
def op8_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bytebpe.digests(documents(spark, sf), BYTE_BPE)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf), WORD_BPE)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op12_exact_dedup", exact_dedup.oracle_sql())
def op12_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf), keep="largest")


@query("op13_collocations", collocations.oracle_sql())
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf))
