"""The long forms against the array forms, over runs of any length, and on one document of half a million lines."""

import random

import pytest
from pyspark.sql import functions as F

from registry_jobs.operators import events, longform, sections, title

LINES = (
    "表題部", "所在", "所在 東京都緑区中央", "東京都緑区中央", "地番 12番3", "地積 100.25㎡", "権利部", "甲区", "乙区", "順位番号 1", "第12号", "345号", "第 7 号", "第7号外", "9番", "所有権移転", "原因 売買",
    "所有者 佐藤一郎", "共同担保目録", "抵当権設定", "順位番号 登記の目的 受付年月日", "地上権設定", "abc def", "12 原因", "受付 第1000号",
)


def documents(n, seed):
    r = random.Random(seed)
    return [(i, [r.choice(LINES) for _ in range(r.randrange(1, 40))]) for i in range(n)]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_long_forms_equal_array_forms(spark, chunk):
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in documents(150, chunk)], "doc_id long, text string")
    arrays = docs.select("doc_id", sections.line_array(F.col("text")).alias("lines")).withColumn("sections", sections.split_sections(F.col("lines"))).cache()
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = longform.clean_lines(raw, chunk).cache()
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, sections.lines_of(docs).collect()))
    cut = longform.split_sections(lines, chunk).cache()
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, sections.section_lines(arrays).collect()))
    found = longform.label_values(cut.where("section = 'title'"), "所在", 6, chunk)
    want = {r.doc_id: r.v for r in arrays.where(F.size("sections.title") > 0).select("doc_id", title.label_value(F.col("sections.title"), "所在", 6).alias("v")).collect()}
    assert {r.doc_id: r.value for r in found.collect()} == want
    entries = longform.segment_entries(cut.where("section = 'kouku'"), chunk).cache()
    for got, make in ((entries, lambda b: b), (longform.merge_receipt_blocks(entries, chunk), events.merge_receipt_blocks)):
        blocks = arrays.select("doc_id", F.posexplode(make(events.segment_entries(events.kouku_body(F.col("sections.kouku"))))).alias("block_no", "b")).select("doc_id", "block_no", F.array_join("b", " | "))
        assert sorted(map(tuple, longform.block_texts(got).collect())) == sorted(map(tuple, blocks.collect()))


def test_one_document_of_half_a_million_lines(spark):
    n = 500_000
    line = F.when(F.col("id") == 0, "権利部").when(F.col("id") == 1, "甲区").when(F.col("id") % 10 == 2, F.concat(F.lit("第"), F.col("id").cast("string"), F.lit("号"))).when(F.col("id") % 10 == 3, F.concat(F.lit("順位番号 "), F.col("id").cast("string")))
    raw = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("line_no"), F.coalesce(line, F.lit("所有者 佐藤一郎")).alias("line"))
    cut = longform.split_sections(longform.clean_lines(raw))
    entries = longform.segment_entries(cut.where("section = 'kouku'"))
    merged = longform.merge_receipt_blocks(entries)
    got = merged.agg(F.count(F.lit(1)), F.count_distinct("block_no"), F.max("block_no")).first()
    # every receipt of ten lines goes to the entry behind it, and both are one block
    assert tuple(got) == (n - 2, n // 10, n // 10 - 1)


def test_lines_are_written_few_times(spark, monkeypatch):
    """Each step reads what the one before made; rounds of first positions are over runs, not lines."""
    made = []
    monkeypatch.setattr(longform, "written", lambda df, real=longform.written: made.append(df) or real(df))
    raw = spark.createDataFrame([(i, n, x) for i, lines in documents(40, 36) for n, x in enumerate(lines)], "doc_id long, line_no long, line string")
    lines = longform.clean_lines(raw, 3)
    blocks = longform.segment_entries(longform.split_sections(lines, 3, only="kouku"), 3)
    assert len(made) == 2
    whole = longform.split_sections(lines, 3)
    for s in ("title", "rights", "kouku", "otsuku", "collateral"):
        assert sorted(map(tuple, longform.split_sections(lines, 3, only=s).collect())) == sorted(map(tuple, whole.where(F.col("section") == s).collect()))
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, longform.segment_entries(whole.where("section = 'kouku'"), 3).collect()))
