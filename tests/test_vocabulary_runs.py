"""The vocabulary works on runs of its letters, each different one once: as every rule on the whole text makes it."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions import text as T
from registry_jobs.plans import catalogue


def odd_texts():
    r = random.Random(28)
    words = [f.replace("_", "") for v, term, _ in P.VOCABULARY for f in (*T.plain_variants(v), term)]
    bits = ["", " ", "\n", "　", " ", "\x85", "5", "佐藤", "。", "𝒳", "O", "s", "辺", "都", "市", "所", "有", "権", "の"]
    blanked = lambda w: "".join(c + (r.choice([" ", "\n", "　 "]) if r.random() < 0.2 else "") for c in w)
    return ["", " ", "所", "都", "所有権" * 200, *["".join(blanked(r.choice(words)) + r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(2500)]]


def test_runs_equal_whole_texts(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    counts = F.array(*[T.vocabulary_count(F.col("t"), v) for v, _, _ in P.VOCABULARY])
    got = df.select("t", T.apply_vocabulary_text(F.col("t")).alias("x"), T.apply_rules(F.col("t"), P.VOCABULARY).alias("y"), T.vocabulary_counts(F.col("t")).alias("n"), F.when(F.col("t").isNotNull(), counts).alias("m")).collect()
    assert len(got) == len(texts) + 1
    assert [x.t for x in got if x.x != x.y or x.n != x.m] == []
    assert sum(x.x != x.t for x in got) > 1500 and all(any(x.n and x.n[k] for x in got) for k in range(len(P.VOCABULARY)))


def test_rules_run_once_a_run():
    texts = [f"共 有 者 佐藤{k}\n受信 第{k}号\n地盤 {k}番{k % 7}" for k in range(20_000)]
    T._kept_run.cache_clear(), T._kept_counts.cache_clear()
    out = next(T._vocabulary_batches(iter([pd.Series(texts)])))
    assert out[7] == "共有者 佐藤7\n受付 第7号\n地盤 7番0"
    assert sum(map(sum, next(T._vocabulary_count_batches(iter([pd.Series(texts)]))))) == 2 * len(texts)
    assert T._kept_run.cache_info().misses < 20 and T._kept_counts.cache_info().misses < 20


@pytest.mark.parametrize("name", ["b06_apply_vocabulary", "b06_vocabulary_count"])
def test_no_pattern_a_rule_over_each_text(spark, sf, name):
    plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?i)rlike|regexp_(?:replace|extract)", plan)) < 5
    assert plan.count("ArrowEvalPython") == 1 or len(re.findall(r"ArrowEvalPython \[", plan)) == 1
