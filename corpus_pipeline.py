"""The corpus pipeline: toxicity, exact dedup, near dedup, source mixing and BPE, one stage after the other.

Each stage takes whatever table the one before wrote: null ids, texts and sources, empty texts, repeated rows,
extra columns of any name and no rows at all; what becomes of each stands with the stages. Texts of any length
are single rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from registry_jobs.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from registry_jobs.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model learns from labelled rows of docs. Null and empty texts stay; repeated rows go or stay together."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group of equal texts: null and empty ones are equal, null ids come last, ties go by the other columns."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each class of near copies: texts without words are near to none, null ids come last."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some not at all, texts without words among them, some up to three times; a null source is a source."""
    return mixing.mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document of the mix; a null text has no tokens."""
    return bpe.encode_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe", to_tokens),
]

#: SQL can't express the stages; tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
