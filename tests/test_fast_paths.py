"""Values that pass by one look give what the steps give, and a look is one."""

import re

from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions import predicates as C
from registry_jobs.functions.text import clean_value, let
from registry_jobs.operators.events import is_receipt_only
from registry_jobs.operators.sections import first_line_index

ODD = ["", " ", "所有者 佐藤一郎", "・所在", ":所在", "所在:", "所 在", "所  在", " 所在", "所在 ", "第　1号", "(所在)", "所在‐1", "あ・い", "ー", "12.5㎡", "　所　　在", "a\nb", "所\t在", "-1", "20/1"]


def _steps(text: str) -> str:
    blank = P.python_pattern(P.WS)
    out = text.translate(str.maketrans("|｜()（）【】「」『』‐‑‒–—―", " " * 12 + "-" * 6))
    out = re.sub(f"^[:：・\\-{P.python_pattern(P.WS_CHARS)}]+", "", out)
    return re.sub(blank + "{2,}", " ", out).strip(P.BLANKS)


def test_clean_values_are_kept(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "x string")
    assert [r[0] for r in df.select(clean_value(F.col("x"))).collect()] == [_steps(x) for x in ODD]


def test_first_line_and_receipts(spark):
    df = spark.createDataFrame([(["表題部", "権利部", "甲区"],), (["あ"],), ([],), (["甲区"],)], "l array<string>")
    assert [r[0] for r in df.select(first_line_index(F.col("l"), "甲区|乙区")).collect()] == [2, -1, -1, 0]
    df = spark.createDataFrame([(["第 1 2号"],), (["第", "12", "号 "],), (["第号"],), (["受付 第1号"],)], "l array<string>")
    assert [r[0] for r in df.select(is_receipt_only(F.col("l"))).collect()] == [True, True, False, False]


def test_an_owner_is_looked_at_few_times(spark):
    looks = spark.range(1).select(C.safe_owner(F.lit("x")).alias("o"))._jdf.queryExecution().analyzed().toString()
    assert looks.count("RLIKE") < 30 and "transform" not in spark.range(1).select(let(F.col("id"), lambda x: x + 1))._jdf.queryExecution().analyzed().toString()


def test_reject_patterns_hold_all_words():
    for words, one in ((f"{P.HEADER}|{P.CONTAMINATION}|{P.NOISE_TOKENS}|{P.OWNER_DATES}|{P.OWNER_EVENTS}", P.OWNER_REJECT), (f"{P.HEADER}|{P.EXCLUDED_RIGHTS}|{P.NOISE_TOKENS}", P.HISTORY_REJECT)):
        for w in words.split("|"):
            text = {"[%@]": "%", "[0-9]+年[0-9]+月[0-9]+日": "1年2月3日"}.get(w, w.replace(".*", ""))
            assert re.search(P.python_pattern(one), text), w
