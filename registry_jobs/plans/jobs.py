"""The three workloads: text to record, readings to elected record, and the corpus report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry_jobs.functions.records import normal_record
from registry_jobs.functions.text import normalize_with_report
from registry_jobs.operators import corpus
from registry_jobs.operators import election as V
from registry_jobs.operators.diagnostics import field_reasons
from registry_jobs.operators.ownership import extract_fields
from registry_jobs.sources.tables import written


def text_to_record(docs: DataFrame) -> DataFrame:
    """(doc_id, fields) from (doc_id, text): narrow steps only, no shuffle."""
    return extract_fields(docs).select("doc_id", "fields")


def scored_readings(readings: DataFrame) -> DataFrame:
    """candidate_set() with `quality`."""
    return V.scored_set(readings)


def with_fields(candidates: DataFrame) -> DataFrame:
    """candidates with `fields`, the text fields and the history read from their normalised text."""
    return candidates.withColumn("fields", normal_record(F.col("raw_text")))


def read_readings(readings: DataFrame) -> DataFrame:
    """The narrow part of an election: every reading with its score and fields, by one helper; no shuffle."""
    return V.scored_set(readings, read=True)


def with_reasons(elected: DataFrame) -> DataFrame:
    return elected.withColumn("reasons", field_reasons(F.col("fields"), F.coalesce("sources", F.create_map().cast("map<string,string>")))).drop("sources")


def readings_to_record(readings: DataFrame) -> DataFrame:
    """(doc_id, fields, raw, accepted, warning, reasons) from (doc_id, source, raw_text), several a document.

    Normalising, scoring and extraction are done once and written; one aggregation on doc_id then elects.
    """
    candidates = written(with_fields(V.gate_ocr(scored_readings(readings))))
    return with_reasons(V.elect(candidates))


def normalized_with_report(docs: DataFrame) -> DataFrame:
    """docs with `normal` (text, corrections): the rule chain with counts, one pass of a vectorised helper."""
    return docs.withColumn("normal", normalize_with_report(F.col("text")))


def corpus_report(docs: DataFrame, top: int = 12) -> DataFrame:
    """(label, corrections, documents): the most frequent corrections over all documents (doc_id, text), one or more texts each."""
    return corpus.correction_totals(normalized_with_report(docs).select("doc_id", F.col("normal.corrections").alias("corrections")), top)
