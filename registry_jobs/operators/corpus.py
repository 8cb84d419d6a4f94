"""Counts over many documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from registry_jobs.functions import quality as Q
from registry_jobs.operators.election import completeness, field_rows


def correction_report(df: DataFrame, top: int = 12, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, rank, label, count) from (keys, corrections map): the most frequent labels of each document, or reading."""
    rows = df.select(*keys, F.explode("corrections").alias("label", "count"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "label"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= top).select(*keys, "rank", "label", "count")


def correction_totals(df: DataFrame, top: int = 12) -> DataFrame:
    """(label, corrections, documents) from (doc_id, corrections map), several rows a document: documents are counted once a label."""
    rows = df.select("doc_id", F.explode("corrections").alias("label", "count"))
    return _top(rows.groupBy("label").agg(F.sum("count").alias("corrections"), F.count_distinct("doc_id").alias("documents")), top)


def _top(totals: DataFrame, top: int) -> DataFrame:
    return totals.orderBy(F.desc("corrections"), "label").limit(top)


SKETCH_BITS = 14  # 2^14 registers: a relative standard error of about 0.8 in 100, in at most 16 KiB a label


def correction_partials(df: DataFrame) -> DataFrame:
    """(label, corrections, sketch) of a batch of (doc_id, corrections map): sums, and a HyperLogLog sketch of the documents.

    Partials of any batches, with documents in common or not, are added up by merged_corrections(): a report over
    all batches reads a row a batch and label. doc_id is a number or a string; null ids aren't counted.
    """
    rows = df.select("doc_id", F.explode("corrections").alias("label", "count"))
    return rows.groupBy("label").agg(F.sum("count").cast("long").alias("corrections"), F.hll_sketch_agg("doc_id", F.lit(SKETCH_BITS)).alias("sketch"))


def merged_corrections(partials: DataFrame, top: int = 12) -> DataFrame:
    """(label, corrections, documents) over partials; `documents` is the sketch's estimate."""
    totals = partials.groupBy("label").agg(F.sum("corrections").alias("corrections"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("documents"))
    return _top(totals, top)


def merged_counts(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the other columns by keys: partials of fill_rates(), completeness_counts(), source_and_tier_counts() and event_counts() of distinct batches."""
    return partials.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in partials.columns if c not in keys])


def fill_rates(df: DataFrame) -> DataFrame:
    """(field, detected, missing) over records (doc_id, fields)."""
    rows = field_rows(df.select("doc_id", "fields"))
    return rows.groupBy("field").agg(F.count(F.when(F.col("value") != "", 1)).alias("detected"), F.count(F.when(F.col("value") == "", 1)).alias("missing"))


def completeness_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(completeness(F.col("fields")).alias("completeness")).agg(F.count(F.lit(1)).alias("documents"))


def source_and_tier_counts(df: DataFrame) -> DataFrame:
    """(source, tier, readings) from (source, quality)."""
    q = F.col("quality")
    tier = F.when(Q.is_strong(q), "strong").when(Q.is_usable(q, F.col("source")), "usable").when(Q.is_previewable(q), "previewable").otherwise("rejected")
    return df.groupBy("source", tier.alias("tier")).agg(F.count(F.lit(1)).alias("readings"))


def event_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("event_type", "invalid").agg(F.count(F.lit(1)).alias("events"))
