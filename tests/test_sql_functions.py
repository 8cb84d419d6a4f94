"""The functions called in SQL against the column functions."""

import random

from pyspark.sql import functions as F

from registry_jobs.functions import sql
from registry_jobs.functions.text import normalize_ocr, vocabulary_chain
from registry_jobs.operators.sections import lines_of


def texts(spark):
    r = random.Random(8)
    signs = ["甲区", "所有者", "佐藤", "10:18", "５３", "㎡", "m", "|", "（", "）", "\n", "\n", " ", "  ", "　", "-", "・", "aaaaaaaa", "ab", "%", " ", "\x85" * 8, "株式会社", "地 番", "...", "'", "\\", "抵当権"]
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randrange(30)))) for i in range(500)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x" * 6000)], "doc_id long, text string")


def test_sql_functions_are_the_column_functions(spark):
    names = sql.register(spark)
    df = texts(spark)
    df.createOrReplaceTempView("t")
    for name, f in sql.COLUMNS.items():
        got = {r.doc_id: r.v for r in spark.sql(f"SELECT doc_id, {name}(text) AS v FROM t").collect()}
        assert got == {r.doc_id: r.v for r in df.select("doc_id", f(F.col("text")).alias("v")).collect()}, name
    got = spark.sql("SELECT doc_id, v.text, v.counts FROM (SELECT doc_id, vocabulary_chain(text) AS v FROM t)")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.select("doc_id", vocabulary_chain(F.col("text")).alias("v")).select("doc_id", "v.text", "v.counts").collect()))
    assert "lines_of" in names


def test_lines_in_sql(spark):
    sql.register(spark)
    df = texts(spark)
    df.createOrReplaceTempView("t")
    got = spark.sql("SELECT doc_id, line_no, line FROM t, LATERAL lines_of(text)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lines_of(df).collect()))
    assert got.count() > 500


def test_text_only_and_counting_normalisers_agree_on_odd_texts(spark):
    from registry_jobs.functions.text import normalize_with_report

    rows = texts(spark).select("doc_id", normalize_ocr(F.col("text")).alias("a"), normalize_with_report(F.col("text")).alias("b")).collect()
    assert [r.doc_id for r in rows if r.a != r.b.text] == []


def test_clean_value_in_sql_is_that_of_the_library(spark):
    """Its let() could not be written as SQL, so that nothing was registered at all."""
    from registry_jobs.functions.text import clean_value

    assert all("lambda" not in sql._sql_of(spark, f(F.col("text")))[0] for f in sql.COLUMNS.values())
    sql.register(spark)
    df = texts(spark)
    df.createOrReplaceTempView("t")
    got = {r.doc_id: r.v for r in spark.sql("SELECT doc_id, clean_value(concat(text, '|')) AS v FROM t").collect()}
    assert got == {r.doc_id: r.v for r in df.select("doc_id", clean_value(F.concat("text", F.lit("|"))).alias("v")).collect()}
