"""Page routing, readings of one document against each other, and the elected record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions import quality as Q
from registry_jobs.functions.predicates import looks_like_address
from registry_jobs.functions.records import scored
from registry_jobs.functions.text import compact, let, normalize_ocr, once

TEXT_FIELDS = ("location", "lot_number", "land_area", "building_area", "owner")


def needs_ocr(page_no: Column, page_text: Column) -> Column:
    """Whether a page's own text is too thin or broken to be read."""

    def of(c: Column) -> Column:
        n = F.length(c)
        keywords = sum((c.contains(k).cast("int") for k in P.ROUTE_KEYWORDS[1:]), c.contains(P.ROUTE_KEYWORDS[0]).cast("int"))
        garble = F.regexp_count(c, F.lit(P.GARBLE))
        first = (n < 160) | ((keywords >= 1) & (n < 220))
        other = F.when((n >= 220) & (garble == 0), False).otherwise((n < 60) | (garble >= 2) | ((keywords >= 1) & (n < 180)))
        return F.when(page_no == 1, first).otherwise(other)

    return let(compact(F.coalesce(page_text, F.lit(""))), of)


def route_pages(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """pages (keys, page_no, page_text) with needs_ocr; page 1 stands in when no page of a document needs it."""
    routed = pages.withColumn("own", needs_ocr(F.col("page_no"), F.col("page_text")))
    some = F.max("own").over(Window.partitionBy(*keys))
    return routed.withColumn("needs_ocr", F.col("own") | (~some & (F.col("page_no") == 1))).drop("own")


def best_variant_per_page(variants: DataFrame) -> DataFrame:
    """The variant of each (doc_id, page_no) with the best preview score; ties by variant_no."""
    scored = variants.withColumn("preview_score", Q.preview_score(Q.text_quality(F.col("page_text"))))
    best = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("preview_score"), "variant_no")
    return scored.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def adopted_source(winners: DataFrame) -> DataFrame:
    """(doc_id, source, text): the variant that won most pages, ties by variant_no; winners' texts in page order."""
    wins = winners.groupBy("doc_id", "variant_no", "source").agg(F.count(F.lit(1)).alias("wins"))
    top = wins.groupBy("doc_id").agg(F.max_by("source", F.struct("wins", -F.col("variant_no"))).alias("source"))
    return top.join(assemble_documents(winners), "doc_id")


def assemble_documents(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, text): page texts in page order, each on a line of its own, trimmed."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("page_text", F.lit("")).alias("t")))), lambda x: x["t"])
    return pages.groupBy(*keys).agg(F.regexp_replace(F.array_join(parts, "\n"), f"^{P.WS}+|{P.WS}+\\z", "").alias("text"))


_ocr_of_raw = once(lambda: normalize_ocr(F.col("raw_text")))


def _of_all(readings: tuple[DataFrame, ...]) -> DataFrame:
    both = readings[0].select("doc_id", "source", "raw_text")
    for r in readings[1:]:
        both = both.unionByName(r.select("doc_id", "source", "raw_text"))
    return both


def _candidate(clean: Column) -> list[Column]:
    order = F.create_map(*[F.lit(x) for k, (s, _) in enumerate(P.SOURCES) for x in (s, k)])
    return [
        F.col("doc_id"),
        F.col("source"),
        order[F.col("source")].alias("arrival_no"),
        F.when(F.col("source") == "server", clean).otherwise(F.col("raw_text")).alias("raw_text"),
        F.when(F.col("source").startswith("ocr-"), clean).otherwise(F.col("raw_text")).alias("scored_text"),
    ]


def candidate_set(*readings: DataFrame) -> DataFrame:
    """(doc_id, source, arrival_no, raw_text, scored_text) of all readings, arrival_no by the fixed order of sources.

    Text layer and server are scored as they are, OCR readings on their normalised text; the server's raw
    text is its normalised one.
    """
    return _of_all(readings).select(*_candidate(_ocr_of_raw()))


def scored_set(readings: DataFrame, read: bool = False) -> DataFrame:
    """candidate_set() with `quality`, and `fields` if read: the record of the normalised raw text."""
    told = F.col("told")
    both = _of_all((readings,)).withColumn("told", scored(F.col("source"), F.col("raw_text"), read))
    return both.select(*_candidate(told["clean"]), told["quality"].alias("quality"), *([told["fields"].alias("fields")] if read else []))


def gate_ocr(candidates: DataFrame) -> DataFrame:
    """Without OCR readings of documents whose best earlier reading is strong, and without OCR texts too short."""
    ocr = F.col("source").startswith("ocr-")
    score = F.when(~ocr, F.struct(F.col("quality.score"), -F.col("arrival_no"), Q.is_strong(F.col("quality")).alias("strong")))
    best = F.max(score).over(Window.partitionBy("doc_id"))
    enough = F.length(compact(F.col("scored_text"))) >= 20
    return candidates.withColumn("strong", F.coalesce(best["strong"], F.lit(False))).where(~ocr | (~F.col("strong") & enough)).drop("strong")


def _elected(candidates: DataFrame, score: Column) -> DataFrame:
    """The row of each document with the best score, ties by arrival: one aggregation, combined before the shuffle."""
    rest = [c for c in candidates.columns if c != "doc_id"]
    best = candidates.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct(score.alias("score"), -F.col("arrival_no"))).alias("best"))
    return best.select("doc_id", "best.*").select(*candidates.columns)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The reading of each document with the best score; ties by arrival."""
    return _elected(candidates, F.col("quality.score"))


def preview_candidate(candidates: DataFrame) -> DataFrame:
    """The previewable reading of each document with the best preview score; ties by arrival."""
    return _elected(candidates.where(Q.is_previewable(F.col("quality"))), Q.preview_score(F.col("quality")))


def field_score(field: str, value: Column, quality: Column, source: Column) -> Column:
    base = quality["label_count"] * 5 + quality["japanese_ratio"] * 20 - quality["noise_ratio"] * 10 + F.when(source == "ocr-normalized", 8).otherwise(0)
    if field == "lot_number":
        base = base + F.when(value.rlike(P.CONFIRMED_NUMBER), 40).otherwise(0)
    elif field in ("land_area", "building_area"):
        base = base + F.when(value.rlike(P.CONFIRMED_AREA), 35).otherwise(0)
    elif field == "owner":
        base = base + F.when(value.rlike("株式会社|有限会社|合同会社|[一-龠]{2,}"), 35).otherwise(-30)
    elif field == "location":
        base = base + F.when(value.rlike("[都道府県市区町村]"), 35).otherwise(-20)
    return F.when(value != "", base)


def _letters_or_marks(value: Column, limit: float) -> Column:
    return let(compact(value), lambda c: (c == "") | (F.regexp_count(c, F.lit(r"[A-Za-z%*@|｜_~#=+<>\\]")) > F.length(c) * limit))


def is_confirmed(field: str, value: Column) -> Column:
    """Whether a field's value may be exported."""
    value = F.coalesce(value, F.lit(""))
    if field == "owner":
        good = ~_letters_or_marks(value, 0.04) & ~looks_like_address(value) & (~value.contains("会社") | value.rlike(P.CONFIRMED_CORPORATION)) & value.rlike(f"{P.CONFIRMED_CORPORATION}|{P.PERSON}")
    elif field == "location":
        good = ~_letters_or_marks(value, 0.06) & ~value.rlike(P.CONFIRMED_LOCATION_REJECT) & value.rlike("[都道府県市区町村]")
    elif field == "lot_number":
        good = ~value.rlike(P.CONFIRMED_NUMBER_REJECT) & value.rlike(P.CONFIRMED_NUMBER)
    else:
        size = F.regexp_extract(value, r"^([0-9]+(?:\.[0-9]+)?)㎡\z", 1).try_cast("double")
        low, high = (10, 1_000_000) if field == "land_area" else (1, 100_000)
        good = F.coalesce(size.between(low, high), F.lit(False))
    return (value != "") & ~value.rlike(P.DANGEROUS) & good


def _merged_fields() -> list[Column]:
    """Aggregates of the best confirmed value of each field, and of the longest history."""
    f, q, source = F.col("fields"), F.col("quality"), F.col("source")
    picks = []
    for name in TEXT_FIELDS:
        value = f[name]
        key = F.when(is_confirmed(name, value), F.struct(field_score(name, value, q, source).alias("s"), (-F.col("arrival_no")).alias("a"), value.alias("v")))
        picks.append(F.coalesce(F.max(key)["v"], F.lit("")).alias(name))
    key = F.when(F.size(f["history"]) > 0, F.struct((F.size(f["history"]) * 12 + q["label_count"] * 2).alias("s"), (-F.col("arrival_no")).alias("a"), f["history"].alias("v")))
    picks.append(F.coalesce(F.max(key)["v"], F.array().cast("array<string>")).alias("history"))
    return picks


def merge_fields(candidates: DataFrame) -> DataFrame:
    """(doc_id, fields) by the best confirmed value of each field: one aggregation, combined before the shuffle."""
    out = candidates.groupBy("doc_id").agg(*_merged_fields())
    return out.select("doc_id", F.struct(*TEXT_FIELDS, "history").alias("fields"))


def field_rows(df: DataFrame) -> DataFrame:
    """(doc_id, ..., field, value) for the text fields of `fields`."""
    rest = [c for c in df.columns if c != "fields"]
    named = F.array(*[F.struct(F.lit(n).alias("field"), F.col("fields")[n].alias("value")) for n in TEXT_FIELDS])
    return df.select(*rest, F.explode(named).alias("x")).select(*rest, "x.field", "x.value")


def source_label(source: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in P.SOURCES for x in pair])[source]


def field_provenance(merged: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, field, source_label): the first reading in order of arrival that has the chosen value."""
    chosen = field_rows(merged.select("doc_id", "fields")).where("value != ''")
    had = field_rows(candidates.select("doc_id", "source", "arrival_no", "fields"))
    return chosen.join(had, ["doc_id", "field", "value"]).groupBy("doc_id", "field").agg(source_label(F.min_by("source", "arrival_no")).alias("source_label"))


def completeness(fields: Column) -> Column:
    parts = [(fields[n] != "").cast("int") for n in TEXT_FIELDS] + [(F.size(fields["history"]) > 0).cast("int")]
    return sum(parts[1:], parts[0])


def has_any(fields: Column) -> Column:
    return completeness(fields) > 0


def decide(best: DataFrame, merged: DataFrame, preview: DataFrame) -> DataFrame:
    """(doc_id, fields, raw, accepted, warning): a usable best reading gives its text; else merged values with a
    warning; else an empty record with a text to look at."""
    b = best.select("doc_id", F.col("raw_text").alias("best_raw"), Q.is_usable(F.col("quality"), F.col("source")).alias("usable"))
    p = preview.select("doc_id", F.col("raw_text").alias("preview_raw"))
    return b.join(merged, "doc_id", "left").join(p, "doc_id", "left").select("doc_id", *_decision())


def _decision() -> list[Column]:
    """fields, raw, accepted and warning from fields, usable, best_raw and preview_raw."""
    empty = F.struct(*[F.lit("").alias(n) for n in TEXT_FIELDS], F.array().cast("array<string>").alias("history"))
    some = F.coalesce(has_any(F.col("fields")), F.lit(False))
    return [
        F.when(F.col("usable") | some, F.col("fields")).otherwise(empty).alias("fields"),
        F.when(F.col("usable"), F.col("best_raw")).otherwise(F.coalesce("preview_raw", F.lit(""))).alias("raw"),
        F.col("usable").alias("accepted"),
        (~F.col("usable")).alias("warning"),
    ]


def elect(candidates: DataFrame) -> DataFrame:
    """(doc_id, fields, raw, accepted, warning, sources): best and preview reading, merged fields, their provenance and the decision.

    One aggregation on doc_id, combined before the shuffle, so there is one exchange of one row a document and
    partition. Of the readings of a value only distinct ones are held, by source and order of arrival. sources
    maps a merged field to the label of the first reading that has its value.
    """
    q, source, early = F.col("quality"), F.col("source"), -F.col("arrival_no")
    best = F.max(F.struct(q["score"].alias("score"), early.alias("early"), F.col("raw_text").alias("raw"), Q.is_usable(q, source).alias("usable")))
    preview = F.max(F.when(Q.is_previewable(q), F.struct(Q.preview_score(q).alias("score"), early.alias("early"), F.col("raw_text").alias("raw"))))
    had = [F.collect_set(F.when(F.col("fields")[n] != "", F.struct("arrival_no", source.alias("source"), F.col("fields")[n].alias("value")))).alias(f"had_{n}") for n in TEXT_FIELDS]
    all_ = candidates.groupBy("doc_id").agg(best.alias("best"), preview.alias("preview"), *_merged_fields(), *had)

    def first(n: str) -> Column:
        return F.struct(F.lit(n).alias("field"), F.when(F.col(n) != "", source_label(F.array_min(F.filter(f"had_{n}", lambda x: x["value"] == F.col(n)))["source"])).alias("label"))

    sources = F.map_from_entries(F.filter(F.array(*[first(n) for n in TEXT_FIELDS]), lambda x: x["label"].isNotNull()))
    out = all_.select("doc_id", F.struct(*TEXT_FIELDS, "history").alias("fields"), F.col("best.raw").alias("best_raw"), F.col("best.usable").alias("usable"), F.col("preview.raw").alias("preview_raw"), sources.alias("sources"))
    return out.select("doc_id", *_decision(), "sources")
