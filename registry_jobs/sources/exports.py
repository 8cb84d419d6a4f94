"""Reading texts and submissions, gates, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions.text import compact, js_trim
from registry_jobs.sources.files import file_uri, read_files, write_documents
from registry_jobs.sources.tables import many_folders, width

FIELDS = ("location", "number", "area", "buildingArea", "owner")
# Rows of the reports, with the field each shows.
REPORT_ROWS = (("最新の持ち主", "owner"), ("所在地", "location"), ("地番", "number"), ("土地の面積", "area"), ("建物の面積", "buildingArea"))
HISTORY_ROW = "持ち主の流れ"
# Answers to what can't be read.
TOO_LITTLE_JSON = "PDFから十分な文字を読み取れませんでした。"
TOO_LITTLE_FILE = "サーバー側でも文字を十分に読み取れませんでした。"
NO_FILE = "PDFが見つかりません。"
BAD_TYPE = "対応していない送信形式です。"
PAYLOAD = "rawText string, format string, fields struct<location string, number string, area string, buildingArea string, owner string, ownersHistory string>"


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(doc_id, page_no, source, page_text) from Parquet or JSON."""
    found = spark.read.format(kind).load(path)
    return found.select("doc_id", F.col("page_no").cast("int").alias("page_no"), *[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in ("source", "page_text")])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, doc_id): each text file under a folder as one text, whatever its line ends; doc_id from the digits at the
    end of its name, null without any. A file is one row, so pages of one document stay together."""
    files, name = read_files(spark, path), F.col("uri")
    if files is None:
        with many_folders(spark):
            files, name = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True), F.col("_metadata.file_path")
    digits = F.regexp_extract(name, r"([0-9]{1,18})[^0-9/]*\z", 1)
    return files.select(name.alias("file"), F.col("value").alias("text"), F.when(digits != "", digits).cast("long").alias("doc_id"))


BROKEN = "JSONとして読み取れません。"
SUBMISSION = "doc_id long, content_type string, text string, body string"


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content_type, text, body, broken) from JSON lines: a line that is no record keeps its own text in `broken`, other columns null."""
    return spark.read.schema(f"{SUBMISSION}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)


def has_enough_text(text: Column) -> Column:
    return F.length(compact(F.coalesce(text, F.lit("")))) >= 20


def reject_reason(content_type: Column, text: Column) -> Column:
    """Why a submission isn't read, null if it is: unknown type, no file, too little text."""
    json, form = content_type.contains("application/json"), content_type.contains("multipart/form-data")
    return (
        F.when(json & ~has_enough_text(text), TOO_LITTLE_JSON)
        .when(json, None)
        .when(form & text.isNull(), NO_FILE)
        .when(form & ~has_enough_text(text), TOO_LITTLE_FILE)
        .when(form, None)
        .otherwise(BAD_TYPE)
    )


def judged(df: DataFrame) -> DataFrame:
    """df (content_type, text, ..., perhaps broken) with `reason`, null where a row is accepted; a record that couldn't be parsed is rejected as that."""
    reason = reject_reason(F.coalesce("content_type", F.lit("")), F.col("text"))
    return df.withColumn("reason", F.when(F.col("broken").isNotNull(), BROKEN).otherwise(reason) if "broken" in df.columns else reason)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) from (content_type, text, ...)."""
    rows = judged(df)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


REASONS = (TOO_LITTLE_JSON, TOO_LITTLE_FILE, NO_FILE, BAD_TYPE, BROKEN)


def write_accepted(df: DataFrame, accepted_path: str, rejected_path: str | None = None) -> dict[str, int]:
    """Write the accepted rows and return how many rows were accepted and rejected for each reason, counted while they pass: one reading of df.

    With rejected_path all rows are written once, dealt by `accepted` into folders of one table there instead, so that
    rejects are kept as well; accepted_path is then the folder `accepted=true` of it.
    """
    seen = Observation()
    counts = [F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"), *[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS]]
    rows = judged(df).observe(seen, *counts)
    if rejected_path is None:
        rows.where("reason is null").drop("reason").write.mode("overwrite").parquet(accepted_path)
    else:
        rows.withColumn("accepted", F.col("reason").isNull()).write.mode("overwrite").partitionBy("accepted").parquet(rejected_path)
    return {k: v for k, v in seen.get.items() if v}


def parse_submissions(df: DataFrame) -> DataFrame:
    """df with raw_text, format and fields from JSON `body`; what is missing is empty, a history that is no list has no items."""
    out = df.select(F.struct("*").alias("row"), F.from_json("body", PAYLOAD).alias("p"))  # no name of df's own can clash
    history = F.filter(F.from_json("p.fields.ownersHistory", "array<string>"), lambda x: x != "")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = F.struct(*[text(f"p.fields.{n}").alias(n) for n in FIELDS], F.coalesce(history, F.array().cast("array<string>")).alias("ownersHistory"))
    made = {"raw_text": text("p.rawText"), "format": text("p.format"), "fields": fields}
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def normalize_fields(df: DataFrame) -> DataFrame:
    """Null texts as empty, null and empty history items left out."""
    history = F.coalesce(F.filter("ownersHistory", lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
    return df.withColumns({**{n: F.coalesce(F.col(n), F.lit("")) for n in FIELDS}, "ownersHistory": history})


def display_value(value: Column) -> Column:
    return F.when(js_trim(F.coalesce(value, F.lit(""))) == "", P.NOT_DETECTED).otherwise(value)


def summary_items() -> list[Column]:
    return [F.struct(F.lit(item).alias("item"), display_value(F.col(n)).alias("value")) for item, n in REPORT_ROWS]


def csv_report(df: DataFrame) -> DataFrame:
    """(doc_id, row_no, item, value): header, fields and history of each record."""
    history = F.when(F.size("ownersHistory") > 0, F.array_join("ownersHistory", " / ")).otherwise(P.NOT_DETECTED)
    rows = F.array(F.struct(F.lit("項目").alias("item"), F.lit("値").alias("value")), *summary_items(), F.struct(F.lit(HISTORY_ROW).alias("item"), history.alias("value")))
    return df.select("doc_id", F.posexplode(rows).alias("row_no", "x")).select("doc_id", "row_no", "x.item", "x.value")


def csv_text(df: DataFrame) -> DataFrame:
    """(doc_id, csv_text): the report as one quoted text with a byte-order mark."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    history = F.when(F.size("ownersHistory") > 0, F.array_join("ownersHistory", " / ")).otherwise(P.NOT_DETECTED)
    rows = F.array(F.struct(F.lit("項目").alias("item"), F.lit("値").alias("value")), *summary_items(), F.struct(F.lit(HISTORY_ROW).alias("item"), history.alias("value")))
    lines = F.transform(rows, lambda r: F.concat(quoted(r["item"]), F.lit(","), quoted(r["value"])))
    return df.select("doc_id", F.concat(F.lit("﻿"), F.array_join(lines, "\n")).alias("csv_text"))


def write_csv_reports(df: DataFrame, path: str) -> None:
    csv_report(df).select("doc_id", "row_no", "item", "value").write.csv(path, quoteAll=True, escape='"', header=False)


def export_documents(df: DataFrame, path: str) -> None:
    """A CSV report for each record in a folder of its own, doc_id=N, with the byte-order mark: the text of csv_text().

    Folders of documents that aren't in df stay as they are, so that a changed document is exported again alone.
    """
    write_texts(csv_text(df).select("doc_id", F.col("csv_text").alias("value")), path)


def write_texts(texts: DataFrame, path: str) -> None:
    """A text file for each doc_id of (doc_id, value), as export_documents() has it.

    Rows are dealt by doc_id first: a document is one file, and a task has few files open at once. The number of tasks
    is said, as by size alone the files of many small documents would be written by one.
    """
    if not write_documents(texts, path):
        dealt = texts.repartition(width(texts.sparkSession), "doc_id").sortWithinPartitions("doc_id")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("doc_id").text(path)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(value, doc_id): the files that export_documents() wrote, each as one text."""
    files = read_files(spark, path, r"^doc_id=(?:0|-?[1-9][0-9]{0,17})/[^/]+\z")
    if files is not None:
        return files.select("value", F.regexp_extract("path", r"doc_id=(-?[0-9]+)/[^/]+\z", 1).cast("long").alias("doc_id"))
    with many_folders(spark):
        return spark.read.text(path, wholetext=True)


def export_workbooks(df: DataFrame, path: str) -> None:
    """Both sheets of each record as tables under doc_id=N/sheet=..., exported again alone like export_documents()."""
    summary, history = workbook_tables(df)
    sheets = summary.withColumn("sheet", F.lit("概要")).unionByName(history.withColumns({"item": F.lit(None).cast("string"), "sheet": F.lit("履歴")}))
    dealt = sheets.repartition(width(df.sparkSession), "doc_id").sortWithinPartitions("doc_id", "sheet", "row_no")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id", "sheet").parquet(path)


def workbook_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sheets 概要 (item, value) and 履歴 (one row an item) of each record, with row numbers."""
    head = F.array(F.struct(F.lit("項目").alias("item"), F.lit("値").alias("value")), *summary_items())
    summary = df.select("doc_id", F.posexplode(head).alias("row_no", "x")).select("doc_id", "row_no", "x.item", "x.value")
    items = F.concat(F.array(F.lit(HISTORY_ROW)), F.when(F.size("ownersHistory") > 0, F.col("ownersHistory")).otherwise(F.array(F.lit(P.NOT_DETECTED))))
    return summary, df.select("doc_id", F.posexplode(items).alias("row_no", "value"))


def export_columns(df: DataFrame) -> DataFrame:
    """The columns that may leave: no raw text, no diagnostics."""
    return df.select("doc_id", *FIELDS, "ownersHistory")
