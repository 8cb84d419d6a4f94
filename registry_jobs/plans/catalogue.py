"""Registered queries over the given tables: one for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions import predicates as C
from registry_jobs.functions import quality as Q
from registry_jobs.functions import text as T
from registry_jobs.functions.records import measured_record
from registry_jobs.functions.sql import register
from registry_jobs.operators import corpus, diagnostics, events, images, longform, ownership, sections, templates, title
from registry_jobs.operators import election as V
from registry_jobs.plans import fixtures as X
from registry_jobs.plans import jobs, oracles
from registry_jobs.sources import exports as E
from registry_jobs.sources.tables import run_dir, written
from registry_jobs.streaming.arrivals import settled, stream_assemble, stream_corrections, stream_elect, stream_extract

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
LIST = " | "


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def _add(name: str, f: Query) -> None:
    _found[name] = f


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _on_docs(name: str, **columns: Callable[[Column], Column]) -> None:
    _add(name, lambda s, d: _docs(s, d).select("doc_id", *[f(F.col("text")).alias(n) for n, f in columns.items()]))


def _on_readings(name: str, **columns: Callable[[Column], Column]) -> None:
    _add(name, lambda s, d: X.reg_docs_noisy(s, d).select("doc_id", "source", *[f(F.col("raw_text")).alias(n) for n, f in columns.items()]))


def _on_lines(name: str, **columns: Callable[[Column], Column]) -> None:
    _add(name, lambda s, d: sections.lines_of(X.reg_docs(s, d)).select("doc_id", "line_no", *[f(F.col("line")).alias(n) for n, f in columns.items()]))


def _on_sections(name: str, **columns: Callable[[], Column]) -> None:
    _add(name, lambda s, d: _parsed(s, d).select("doc_id", *[f().alias(n) for n, f in columns.items()]))


def _on_entries(name: str, *columns: str | Callable[[], Column]) -> None:
    _add(name, lambda s, d: events.entry_rows(_parsed(s, d)).select("doc_id", "entry_no", *_made(columns)))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return ownership.with_lines(X.reg_docs(spark, sf))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return E.normalize_fields(X.records(spark, sf))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return ownership.extract_normalized(X.reg_docs(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Readings scored on their own text, as SQL can follow."""
    return X.reg_docs_noisy(spark, sf).select("doc_id", "source", "arrival_no", "raw_text", F.col("raw_text").alias("scored_text"), Q.text_quality(F.col("raw_text")).alias("quality"))


def _quality(name: str, *columns: Callable[[], Column]) -> None:
    _add(name, lambda s, d: _scored(s, d).select("doc_id", "source", *_made(columns)))


def _joined(values: str | Column) -> Column:
    return F.array_join(values, LIST)


def _made(columns: tuple) -> list:
    """Columns are made when a query runs: there may be no session before."""
    return [c if isinstance(c, str) else c() for c in columns]


def q() -> Column:
    return F.col("quality")


# A. Sources, gates, exports
_add("a01_read_pages", lambda s, d: E.read_pages(s, written(X.reg_pages(s, d))._scratch_path))
_add("a02_assemble_documents", lambda s, d: V.assemble_documents(X.reg_pages(s, d), ("doc_id", "source")))
_on_docs("a03_enough_text", enough=E.has_enough_text)
_add("a04_split_rejects", lambda s, d: X.submissions(s, d).select("doc_id", E.reject_reason(F.col("content_type"), F.col("text")).alias("reason")))


@query
def a01_read_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents landed as text files, one each, and read back: id and characters."""
    base = f"{run_dir(spark)}/texts-{uuid.uuid4().hex}"
    small = _docs(spark, sf).where("length(text) > 0")
    E.write_texts(small.select("doc_id", F.col("text").alias("value")), base)
    found = E.read_texts(spark, base).withColumn("text", F.regexp_replace("text", "\n\\z", ""))
    return found.select(F.regexp_extract("file", "doc_id=([0-9]+)", 1).cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query
def a04_reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions landed as JSON lines, every ninth cut off, read back with the reason of each reject."""
    base = f"{run_dir(spark)}/submissions-{uuid.uuid4().hex}"
    whole = F.to_json(F.struct("doc_id", "content_type", "text", "body"))
    cut = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "content'))).otherwise(whole)
    X.submissions(spark, sf).select(cut.alias("value")).write.text(base)
    rows = E.judged(E.read_submissions(spark, base)).where("reason is not null")
    return rows.select(F.coalesce("doc_id", F.regexp_extract("broken", "[0-9]+", 0).cast("long")).alias("doc_id"), "reason")


@query
def a04_observed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows accepted, and rejected for each reason, counted while the accepted ones are written."""
    counts = E.write_accepted(X.submissions(spark, sf), f"{run_dir(spark)}/accepted-{uuid.uuid4().hex}")
    return spark.createDataFrame(sorted(counts.items()), "outcome string, n long")


@query
def a08_export_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file for each record, read back whole."""
    base = f"{run_dir(spark)}/reports-{uuid.uuid4().hex}"
    E.export_documents(_records(spark, sf), base)
    back = E.read_exports(spark, base)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace("value", "\n\\z", "").alias("csv_text"))


@query
def a05_parse_submissions(spark: SparkSession, sf: str) -> DataFrame:
    f = E.parse_submissions(X.submissions(spark, sf).drop("text"))
    return f.select("doc_id", "raw_text", "format", "fields.location", "fields.owner", _joined("fields.ownersHistory").alias("history"))


def _export(df: DataFrame) -> DataFrame:
    return E.export_columns(df).select("doc_id", *E.FIELDS, _joined("ownersHistory").alias("history"))


_add("a06_normalize_fields", lambda s, d: _export(_records(s, d)))
_add("a07_display_value", lambda s, d: _records(s, d).select("doc_id", E.display_value(F.col("location")).alias("location"), E.display_value(F.col("buildingArea")).alias("building_area")))
_add("a08_csv_report", lambda s, d: E.csv_report(_records(s, d)))
_add("a08_csv_text", lambda s, d: E.csv_text(_records(s, d)))
_add("a09_workbook_summary", lambda s, d: E.workbook_tables(_records(s, d))[0])
_add("a09_workbook_history", lambda s, d: E.workbook_tables(_records(s, d))[1])
_add("a10_export_columns", lambda s, d: _export(_records(s, d).withColumn("raw", F.lit("x"))))

# B. Normalisation
_on_docs("b01_fold_chars", text=T.fold_chars)
_on_docs("b02_join_digit_separators", text=T.join_digit_separators)
_on_docs("b03_collapse_ws", text=T.collapse_ws)
_on_readings("b04_repair_numbers", text=lambda x: T.repair_numbers(x)["text"], changed_lines=lambda x: T.repair_numbers(x)["changed_lines"])


@query
def b05_repair_places(spark: SparkSession, sf: str) -> DataFrame:
    spoiled = X.reg_docs_noisy(spark, sf).select("doc_id", "source", T.repair_places(F.replace("raw_text", F.lit("郡山市"), F.lit("都山市"))).alias("r"))
    return spoiled.select("doc_id", "source", "r.text", "r.changed")


_on_readings("b06_apply_vocabulary", text=T.apply_vocabulary_text)


@query
def b06_vocabulary_count(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    found = X.reg_docs_noisy(spark, sf).select("doc_id", "source", T.vocabulary_counts(F.col("raw_text")).alias("n"))
    return found.select("doc_id", "source", F.get(n, F.lit(10)).alias("causes"), F.get(n, F.lit(4)).alias("rights"), F.coalesce(F.array_join(n.cast("array<string>"), ","), F.lit("")).alias("counts"))


_on_readings("b07_despace_lines", text=T.despace_lines)
_on_readings("b08_normalize_text", text=T.normalize_text)
_on_readings("b09_normalize_labels", text=T.normalize_labels)
_on_docs("b10_clean_value", text=T.clean_value)
_add("b11_lines_of", lambda s, d: sections.lines_of(X.reg_docs(s, d)))
_add("b12_unique_clean", lambda s, d: X.reg_docs(s, d).select("doc_id", _joined(T.unique_clean(F.split("text", "\n", -1))).alias("items")))


def _reported(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.normalized_with_report(X.reg_docs_noisy(spark, sf).select("doc_id", "source", F.col("raw_text").alias("text")))


def _counts(corrections: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(corrections)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ", ")


_add("b13_correction_report", lambda s, d: corpus.correction_report(_reported(s, d).select("doc_id", "source", F.col("normal.corrections").alias("corrections")), keys=("doc_id", "source")))


@query
def b14_normalization_summary(spark: SparkSession, sf: str) -> DataFrame:
    both = _docs(spark, sf).select("doc_id", Q.text_quality(F.col("text")).alias("a"), Q.text_quality(T.fold_chars(F.col("text"))).alias("b"))
    return both.select("doc_id", _joined(Q.normalization_summary(F.col("a"), F.col("b"))).alias("summary"))


_on_docs("b15_clip_text", text=T.clip_text)
_add("b16_normalize_with_report", lambda s, d: _reported(s, d).select("doc_id", "source", "normal.text", _counts(F.col("normal.corrections")).alias("corrections")))


# N. The same in SQL
@query
def n_column_functions(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    _docs(spark, sf).createOrReplaceTempView("n_texts")
    return spark.sql("SELECT doc_id, fold_chars(text) AS folded, join_digit_separators(text) AS joined, clean_value(text) AS cleaned, clip_text(text) AS clipped, has_enough_text(text) AS enough, has_noise_token(text) AS noise FROM n_texts")


@query
def n_lines_of(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    X.reg_docs(spark, sf).createOrReplaceTempView("n_certificates")
    return spark.sql("SELECT doc_id, line_no, line FROM n_certificates, LATERAL lines_of(text)")


# C. Predicates
@query
def c01_is_noise_line(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.transform(F.split(F.replace("text", F.lit("."), F.lit("\n")), "\n", -1), C.is_noise_line)
    return _docs(spark, sf).select("doc_id", F.size(cut).cast("long").alias("n"), F.size(F.filter(cut, lambda x: x)).cast("long").alias("noise"))


_on_docs("c02_looks_like_garbage", flag=C.looks_like_garbage)
_on_lines("c03_is_plausible", flag=C.is_plausible)
_on_lines("c04_has_contamination", flag=C.has_contamination)
_on_docs("c05_noise_ratios", ascii_noise=C.ascii_noise, symbol_noise=C.symbol_noise)
_on_docs("c06_has_noise_token", flag=C.has_noise_token)


@query
def c07_header_or_excluded(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.reg_docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.select("doc_id", "line", C.is_header(F.col("line")).alias("header"), C.is_excluded_right(F.col("line")).alias("excluded"))


_on_lines("c08_looks_like", corp=C.looks_like_corp, person=C.looks_like_person, address=C.looks_like_address)


def _value(line: Column) -> Column:
    return F.regexp_replace(line, "^[^ ]+ ", "")


_on_lines("c09_safe_location", value=lambda x: C.safe_location(_value(x)))
_on_lines("c10_safe_number", value=lambda x: C.safe_number(_value(x)))
_on_lines("c11_areas", normalized=lambda x: C.normalize_area(_value(x)), safe=lambda x: C.safe_area(_value(x)))
_on_lines("c12_safe_owner", value=lambda x: C.safe_owner(_value(x)))
_on_lines("c13_is_history_noise", flag=C.is_history_noise)
_on_readings("c14_count_history_noise", n=C.count_history_noise)


# D. Sections
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return X.reg_docs(spark, sf).select("doc_id", sections.line_array(F.col("text")).alias("lines"))


_add("d01_first_line_index", lambda s, d: _lines(s, d).select("doc_id", sections.first_line_index(F.col("lines"), "甲区").alias("kouku"), sections.first_line_index(F.col("lines"), "乙区", F.size("lines")).alias("otsuku")))
_add("d02_cut_excluded", lambda s, d: _lines(s, d).select("doc_id", _joined(sections.cut_excluded(F.col("lines"))).alias("lines")))
_add("d03_split_sections", lambda s, d: sections.section_lines(_lines(s, d).select("doc_id", sections.split_sections(F.col("lines")).alias("sections"))))

# E. Title fields
_on_lines("e01_value_after_label", number=lambda x: title.value_after_label(x, "地番"), area=lambda x: title.value_after_label(x, "地積"))
def _t() -> Column:
    return F.col("sections.title")


def _all() -> Column:
    return F.col("lines")


_on_sections("e02_label_value", location=lambda: title.label_value(_t(), "所在", 6), number=lambda: title.label_value(_t(), "地番", 5))
_on_sections("e03_inline_row_value", location=lambda: title.inline_row_value(_t(), "所在"), number=lambda: title.inline_row_value(_t(), "地番"))
_on_sections("e04_area_by_label", title_area=lambda: title.area_by_label(_t(), "地積", 5), floor_area=lambda: title.area_by_label(_all(), "床面積", 2))
_on_sections("e05_extract_location", location=lambda: title.extract_location(_t()))
_on_sections("e06_extract_lot_number", lot_number=lambda: title.extract_lot_number(_t()))
_on_sections("e07_extract_areas", land_area=lambda: title.extract_land_area(_t(), _all()), building_area=lambda: title.extract_building_area(_t(), _all()))

# F. Events
_on_lines("f01_is_entry_start", flag=events.is_entry_start)


def _blocks(name: str, make: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = _parsed(spark, sf).select("doc_id", F.posexplode(make(events.segment_entries(events.kouku_body(F.col("sections.kouku"))))).alias("block_no", "b"))
        return found.select("doc_id", "block_no", _joined("b").alias("lines"))

    _add(name, run)


_blocks("f02_segment_entries", lambda b: b)
_blocks("f03_merge_receipt_blocks", events.merge_receipt_blocks)
_on_entries("f04_entry_cause", "cause")
_on_entries("f05_entry_receipt", "receipt")
_on_entries("f06_entry_purpose", "purpose")
_on_entries("f07_owner_candidates", lambda: _joined("owners").alias("owners"))
_on_entries("f08_event_type", "event_type")
_on_entries("f09_invalid_or_ownership", "invalid", "ownership_event")
_on_entries("f10_has_shared_marker", "shared")
_on_entries("f11_share_fraction", "share")
_on_entries("f12_share_and_person_candidates", lambda: F.size(events.share_candidates(F.col("lines"))).alias("shares"), lambda: _joined("persons").alias("persons"))
_on_entries("f13_parse_entries", lambda: _joined("lines").alias("lines"), "purpose", "receipt", "cause", lambda: _joined("owners").alias("owners"), "event_type", "invalid", "ownership_event")

# D to F in long form: a row a line
def _raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    return X.reg_docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return written(longform.clean_lines(_raw_lines(spark, sf)))


def _register(spark: SparkSession, sf: str) -> DataFrame:
    return longform.segment_entries(longform.split_sections(_long(spark, sf), only="kouku"))


@query
def d01_first_line_long(spark: SparkSession, sf: str) -> DataFrame:
    rows = _long(spark, sf)
    at = lambda pattern, name: longform.first_line(rows, pattern).withColumnRenamed("at", name)
    n = rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    both = at("甲区", "kouku").join(at("乙区", "otsuku"), "doc_id").join(n, "doc_id")
    return both.select("doc_id", F.col("kouku").cast("int").alias("kouku"), F.when(F.col("otsuku") < 0, F.col("n")).otherwise(F.col("otsuku")).cast("int").alias("otsuku"))


_add("d03_split_sections_long", lambda s, d: longform.split_sections(_long(s, d)))


@query
def e02_label_value_long(spark: SparkSession, sf: str) -> DataFrame:
    found = longform.split_sections(_long(spark, sf), only="title")
    of = lambda label, ahead, name: longform.label_values(found, label, ahead).withColumnRenamed("value", name)
    return of("所在", 6, "location").join(of("地番", 5, "number"), "doc_id")


_add("f02_segment_entries_long", lambda s, d: longform.block_texts(_register(s, d)))
_add("f03_merge_receipt_blocks_long", lambda s, d: longform.block_texts(longform.merge_receipt_blocks(_register(s, d))))

# G. Ownership and the record
def _e() -> Column:
    return F.col("entries")


_on_sections("g1_replay_ownership", owner=lambda: ownership.replay(_e())["owner"])
_add("g1_replay_rows", lambda s, d: ownership.replay_rows(events.entry_rows(_parsed(s, d))))
_on_sections("g2_ownership_diagnostics", diagnostics=lambda: _joined(ownership.replay(_e())["diagnostics"]))
_on_sections("g3_latest_owners", owners=lambda: _joined(ownership.latest_owners(_e())))
_on_sections("g4_owner_history", history=lambda: _joined(ownership.owner_history(_e(), _all())))
_on_sections("g5_fallback_owners", owners=lambda: _joined(ownership.fallback_owners(_all(), ownership.owner_history(_e(), _all()))))
_add("g6_extract_fields", lambda s, d: _extracted(s, d).select("doc_id", *[F.col(f"fields.{n}") for n in V.TEXT_FIELDS], _joined("fields.history").alias("history")))
_add("g7_field_diagnostics", lambda s, d: _extracted(s, d).select("doc_id", _joined("fields.field_diagnostics").alias("diagnostics")))


# H. Quality, routing, election
def _six(x: Column | str) -> Column:
    return F.round(x, 6)


_quality(
    "h1_text_quality", lambda: _six(q()["score"]).alias("score"), lambda: q()["label_count"].cast("long").alias("label_count"), lambda: _six(q()["japanese_ratio"]).alias("japanese_ratio"), lambda: _six(q()["noise_ratio"]).alias("noise_ratio"),
    lambda: q()["garbage_lines"].cast("long").alias("garbage_lines"), lambda: q()["length"].cast("long").alias("length"), lambda: q()["line_count"].cast("long").alias("line_count"),
)


@query
def h1_text_quality_real(spark: SparkSession, sf: str) -> DataFrame:
    scored = _docs(spark, sf).select("doc_id", Q.text_quality(F.col("text")).alias("quality"))
    return scored.select("doc_id", _six(q()["score"]).alias("score"), q()["garbage_lines"].cast("long").alias("garbage_lines"), q()["length"].cast("long").alias("length"))


_quality("h2_is_usable", lambda: Q.is_usable(q(), F.col("source")).alias("usable"))
_quality("h3_previewable_strong", lambda: Q.is_previewable(q()).alias("previewable"), lambda: Q.is_strong(q()).alias("strong"))
_quality("h4_preview_score", lambda: _six(Q.preview_score(q())).alias("preview_score"))
_add("h5_route_pages", lambda s, d: V.route_pages(X.reg_pages(s, d), ("doc_id", "source")).select("doc_id", "source", "page_no", "needs_ocr"))
_add("h6_best_variant_per_page", lambda s, d: V.best_variant_per_page(X.reg_pages(s, d)).select("doc_id", "page_no", "source"))
_add("h7_adopted_source", lambda s, d: V.adopted_source(V.best_variant_per_page(X.reg_pages(s, d))).select("doc_id", "source", "text"))


@query
def h8_candidate_set(spark: SparkSession, sf: str) -> DataFrame:
    r = X.reg_docs_noisy(spark, sf)
    return V.candidate_set(r.where("arrival_no < 2"), r.where("arrival_no >= 2"))


_add("h9_gate_ocr", lambda s, d: V.gate_ocr(_scored(s, d)).select("doc_id", "source"))
_add("h10_best_candidate", lambda s, d: V.best_candidate(_scored(s, d)).select("doc_id", "source"))
_add("h10_preview_candidate", lambda s, d: V.preview_candidate(_scored(s, d)).select("doc_id", "source"))


def _read(spark: SparkSession, sf: str, *texts: str) -> DataFrame:
    """All readings of each certificate with quality and fields, and those of their texts that are asked for."""
    told = X.reg_docs_noisy(spark, sf).withColumn("told", measured_record(F.col("raw_text")))
    return told.select("doc_id", "source", "arrival_no", *texts, "told.quality", "told.fields")


@query
def h11_field_score(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("fields")
    return _read(spark, sf).select("doc_id", "source", *[_six(V.field_score(n, f[n], q(), F.col("source"))).alias(n) for n in V.TEXT_FIELDS])


_add("h12_is_confirmed", lambda s, d: _extracted(s, d).select("doc_id", *[V.is_confirmed(n, F.col(f"fields.{n}")).alias(n) for n in V.TEXT_FIELDS]))
_add("h13_merge_fields", lambda s, d: V.merge_fields(_read(s, d)).select("doc_id", *[F.col(f"fields.{n}") for n in V.TEXT_FIELDS], _joined("fields.history").alias("history")))


@query
def h14_field_provenance(spark: SparkSession, sf: str) -> DataFrame:
    read = written(_read(spark, sf))
    return V.field_provenance(V.merge_fields(read), read)


_add("h15_completeness", lambda s, d: _extracted(s, d).select("doc_id", V.completeness(F.col("fields")).alias("completeness")))


@query
def h16_decide(spark: SparkSession, sf: str) -> DataFrame:
    read = written(_read(spark, sf, "raw_text"))
    out = V.decide(V.best_candidate(read), V.merge_fields(read), V.preview_candidate(read))
    return out.select("doc_id", "fields.owner", "fields.location", "raw", "accepted", "warning")


# I. Diagnostics
_add("i1_structure_summary", lambda s, d: _extracted(s, d).select("doc_id", _joined(diagnostics.structure_summary(F.col("text"), F.col("fields"))).alias("summary")))
_add("i2_field_reasons", lambda s, d: jobs.readings_to_record(X.reg_docs_noisy(s, d)).select("doc_id", _joined("reasons").alias("reasons")))
_add("i3_extracted_summary", lambda s, d: _extracted(s, d).select("doc_id", diagnostics.extracted_summary(F.col("fields")).alias("summary")))
_quality("i3_read_meta", lambda: diagnostics.read_meta(V.source_label(F.col("source")), q()).alias("meta"))


# J. Templates
@query
def j2_template_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    named = {"propertyName": "owner", "lotNumber": "number", "landArea": "area"}
    r = X.records(spark, sf)
    filled = r.select(*[F.lit("x").alias(k) if k == "usage" else F.col(named.get(k, k)).alias(k) for k in templates.KEYS])
    return templates.coverage(filled, templates.template_catalogue(spark))



@query
def j1_apply_templates(spark: SparkSession, sf: str) -> DataFrame:
    c = X.table(spark, sf, "customer")
    records = c.select(
        F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("propertyName"), F.col("c_mktsegment").alias("location"), F.col("c_custkey").cast("string").alias("lotNumber"), F.lit("").alias("landArea"),
        F.lit(None).cast("string").alias("buildingArea"), F.col("c_mktsegment").alias("usage"), F.col("c_name").alias("owner"),
    )
    return templates.apply_templates(records, templates.template_catalogue(spark))


# K. Images
def _grey(spark: SparkSession, sf: str, preset: str = "binary") -> DataFrame:
    return images.tone_map(X.pixels(spark, sf), *images.TONES[preset])


_add("k1_tone_map", lambda s, d: _grey(s, d, "light"))
_add("k2_otsu_threshold", lambda s, d: images.otsu_threshold(_grey(s, d)))


@query
def k3_binarize_despeckle(spark: SparkSession, sf: str) -> DataFrame:
    grey = written(_grey(spark, sf))
    return images.binarize_despeckle(grey, images.otsu_threshold(grey))


@query
def k_clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each picture as an RGB row, cleaned by tiles of 4 x 4, uncropped: the pixels are those of k3."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))), lambda p: F.concat(*[F.lpad(F.hex(p[c]), 2, "0") for c in "rgb"]))
    whole = X.pixels(spark, sf).groupBy("image_id").agg(F.unhex(F.array_join(order, "")).alias("rgb")).withColumns({"width": F.lit(8), "height": F.lit(8)})
    pages = images.clean_pages(whole, "binary", pad=1000, side=4)
    at = F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)
    px = pages.select(F.col("image_id").cast("long").alias("image_id"), F.posexplode(F.transform(at, lambda i: F.conv(F.hex(F.substring("gray", i + 1, F.lit(1))), 16, 10).cast("int"))).alias("p", "value"), "width")
    return px.select("image_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).alias("x"), "value")


_add("k4_auto_crop", lambda s, d: images.auto_crop(_grey(s, d), pad=1))


@query
def k_clean_images(spark: SparkSession, sf: str) -> DataFrame:
    bits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "r"))), lambda p: F.lpad(F.hex(p["r"]), 2, "0")), "")
    whole = X.pixels(spark, sf).groupBy("image_id").agg(F.unhex(bits).alias("gray")).withColumns({"width": F.lit(8), "height": F.lit(8)})
    return images.clean_images(whole, "binary", 1).select("image_id", "width", "height", F.sha2("gray", 256).alias("sha256"))


# L. Corpus
_add("l1_correction_totals", lambda s, d: jobs.corpus_report(X.reg_docs_noisy(s, d).select("doc_id", F.col("raw_text").alias("text"))))
_add("l2_fill_rates", lambda s, d: corpus.fill_rates(_extracted(s, d)))
_add("l2_completeness_counts", lambda s, d: corpus.completeness_counts(_extracted(s, d)))
_add("l3_source_and_tier_counts", lambda s, d: corpus.source_and_tier_counts(_scored(s, d)))
_add("l4_event_counts", lambda s, d: corpus.event_counts(events.entry_rows(_parsed(s, d))))

# Workloads
_add("w1_text_to_record", lambda s, d: jobs.text_to_record(X.reg_docs(s, d)).select("doc_id", *[F.col(f"fields.{n}") for n in V.TEXT_FIELDS], _joined("fields.history").alias("history")))
def _whole(records: DataFrame) -> DataFrame:
    return records.select("doc_id", *[F.col(f"fields.{n}") for n in V.TEXT_FIELDS], _joined("fields.history").alias("history"), "raw", "accepted", "warning", _joined("reasons").alias("reasons"))


_add("w2_readings_to_record", lambda s, d: _whole(jobs.readings_to_record(X.reg_docs_noisy(s, d))))


@query
def w3_corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    """Over the given documents and all readings: the latter hold what is corrected."""
    own = lambda mark: F.concat(F.lit(mark), F.col("doc_id").cast("string")).alias("doc_id")
    return jobs.corpus_report(_docs(spark, sf).select(own("d"), "text").unionByName(X.reg_docs_noisy(spark, sf).select(own("r"), F.col("raw_text").alias("text"))))


# M. Streaming
@query
def m1_stream_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Certificates landed as files, extracted by the stream and read back."""
    landed, base = written(X.reg_docs(spark, sf)), f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream_extract(spark, landed._scratch_path, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", *[F.col(f"fields.{n}") for n in V.TEXT_FIELDS], _joined("fields.history").alias("history"))


@query
def m1_stream_elect(spark: SparkSession, sf: str) -> DataFrame:
    """All readings, landed in shuffled order as files of several batches, and what the stream holds after the last."""
    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    X.reg_docs_noisy(spark, sf).select("doc_id", "source", "raw_text").repartition(4, F.xxhash64("source", "doc_id")).write.parquet(f"{base}/in")
    stream_elect(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", files_per_batch=2).awaitTermination()
    return _whole(settled(spark, f"{base}/out"))


@query
def m1_stream_assemble(spark: SparkSession, sf: str) -> DataFrame:
    """All pages, landed in shuffled order as files of several batches, and the texts that the stream holds after the last."""
    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    X.reg_pages(spark, sf).select("doc_id", "page_no", "source", "page_text").repartition(6, F.xxhash64("source", "doc_id", "page_no")).write.parquet(f"{base}/in")
    stream_assemble(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", files_per_batch=2).awaitTermination()
    return settled(spark, f"{base}/out")


@query
def m1_stream_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections by label, summed over what each batch of the stream left: documents by sketch, so without the exact count."""
    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    X.reg_docs_noisy(spark, sf).select("doc_id", F.col("raw_text").alias("text")).repartition(4, F.xxhash64("doc_id", "text")).write.parquet(f"{base}/in")
    stream_corrections(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", files_per_batch=2).awaitTermination()
    return corpus.merged_corrections(spark.read.parquet(f"{base}/out")).select("label", "corrections")


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
