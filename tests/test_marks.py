"""What a line tells, looked at once a different line, gives what the columns on bare lines give."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from registry_jobs.functions import marks as M
from registry_jobs.functions import patterns as P
from registry_jobs.operators import events, ownership, sections

ODD = ["", " ", "12", "a\x85b", "ああああああああ", "(株)", "・所 在", "‐‐", "第", "号", "第 3 号", "受付 第12号", "持分 2分の1", "権利者: 佐藤 持分", "原因", "原因 ", "原因：", "原因 令和1年2月3日売買", "連帯債務者", "BRd", "Ana", "BRd Ana", "ABCD EFGH ijklm", "�", "第11111111号"]
HOLD = [f"{h}{s}{n}" for h in ("所有者", "共有者", "権利者その他事項", "氏名") for s in ("", " ", "：") for n in ("佐藤一郎", "鈴木花子/田中", "株式会社青空", "住所 東京", "佐藤 持分 x", "会社", "OCR候補", "x")]
EVENTS = ["順位番号 1", "所有権移転", "所有権一部移転", "持分一部移転", "所有権移転抹消", "登記の目的 所有権保存", "1 登記", "甲区", "乙区", "権利部", "表題部", "共同担保目録", "順位番号 登記の目的", "所在 東京都緑区", "地番 1番2", "床面積 30.5㎡"]


def odd_texts(n):
    r = random.Random(30)
    line = lambda: r.choice(r.choice((ODD, HOLD, EVENTS, EVENTS))) + r.choice(["", "", " ", "x", r.choice(ODD)])
    return ["", *["\n".join(["甲区"] * r.randrange(2) + [line() for _ in range(r.randrange(25))]) for _ in range(n)]]


def test_marks_equal_bare_lines(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts(1500)], "text string")
    bare = df.withColumn("lines", sections.line_array(F.col("text"))).withColumn("sections", sections.split_sections(F.col("lines"))).withColumn("entries", events.parse_entries(F.col("sections.kouku")))
    got = ownership.with_lines(df)
    shown = lambda d: sorted(x[0] for x in d.select(F.to_json(F.struct("text", "lines", "sections", F.transform("entries", lambda e: e.dropFields("plain")).alias("entries")))).collect())
    assert shown(got) == shown(bare)
    # what is told of plain entries is told without looking
    told = lambda d: sorted(str(x) for x in d.select("text", ownership.owner_history(F.col("entries"), F.col("lines")).alias("h"), ownership.replay(F.col("entries")).alias("s")).collect())
    assert told(got) == told(bare)
    assert got.where(F.exists("entries", lambda e: e["plain"] & (F.size(e["owners"]) > 0))).count() > 100


def test_lines_are_looked_at_once():
    texts = pa.array([f"甲区\n順位番号 {k % 9}\n所有権移転\n受付 第{k % 50}号\n所有者 佐藤一郎" for k in range(20_000)] + [None])
    M._kept_mark.cache_clear()
    out = next(M._mark_batches(iter([texts])))
    assert len(out) == 20_001 and out[20_000].as_py() == [] and out[7].as_py()[4]["owners"] == ["佐藤一郎"]
    assert M._kept_mark.cache_info().misses < 70


def test_few_looks_at_a_record(spark):
    df = spark.createDataFrame([(1, "甲区")], "doc_id long, text string")
    plan = ownership.extract_normalized(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RLIKE", plan)) < 400  # 479 when each step looked at its lines


def test_doubtful_words_are_all_there():
    for w in (*P.HEADER.split("|"), *P.EXCLUDED_RIGHTS.split("|"), *P.NOISE_TOKENS.split("|")):
        text = "%" if w == "[%@]" else w.replace(".*", "x")
        assert M._looks()[M.DOUBTFUL].search(text), w
