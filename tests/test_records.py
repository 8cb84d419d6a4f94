"""The record made by one helper is that of the built-in functions, and is made once for what readings repeat."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from registry_jobs.functions import records as R
from registry_jobs.operators import ownership
from registry_jobs.plans import catalogue
from registry_jobs.plans import fixtures as X
from tests.test_marks import odd_texts
from tests.test_registry import CASES

TITLES = [
    "所在 東京都緑区中央", "所在", "所在地", "東京都青葉市緑町", "所在 東京都緑区 地番 7番 地積 45.00㎡", "地番 12番3", "地番", "12番3", "53-1", "地積 88平方メートル", "地積", "123.456㎡", "5㎡", "床面積 30.5 ㎡", "建物面積 12㎡", "地図番号 A1",
    "表題部", "土地の表示", "所在 ABCD", "所在　大阪府  桜町", "地番 x 9", "床面積", "構造 木造", "甲区", "権利者: 佐藤一郎 / 田中花子", "持分", "所有者 鈴木花子 持分 2分の1", "99999999㎡", "都市", "所在 %%%", "第1号", "1番地", "ab", "(地番) 3番", "所在\x85東京都緑区",
]


def texts(n):
    r = random.Random(4)
    titled = ["\n".join(r.choice(TITLES) + r.choice(["", "", " ", r.choice(TITLES)]) for _ in range(r.randrange(9))) for _ in range(2 * n)]
    odd = odd_texts(n)
    both = [f"{a}\n{r.choice(['', '権利部', '甲区', '乙区', '共同担保目録'])}\n{b}" for a, b in zip(titled, odd)]
    return [None, "a\n" * 30_000, *[c[1] for c in CASES], *titled, *odd, *both]


def test_records_equal_built_in_functions(spark):
    rows = spark.createDataFrame(list(enumerate(texts(1500))), "doc_id long, text string").repartition(8)
    certificates = X.reg_docs_noisy(spark, "/root/testdata/sf0.001").select(F.monotonically_increasing_id().alias("doc_id"), F.col("raw_text").alias("text"))
    for df in (rows, certificates):
        want = ownership.extract_normalized(df).select("doc_id", *[f"fields.{n}" for n in (*R.FIELDS, "history")])
        got = df.select("doc_id", R.record(F.col("text")).alias("f")).select("doc_id", "f.*")
        a, b = ({r[0]: tuple(r)[1:] for r in d.collect()} for d in (got, want))
        assert a.keys() == b.keys() and [(k, a[k], b[k]) for k in a if a[k] != b[k]] == []
    assert len({r[0] for r in rows.select(R.record(F.col("text"))["owner"]).collect()}) > 30


def test_what_readings_repeat_is_read_once(monkeypatch):
    """Entries were read again for each reading."""
    seen = []
    monkeypatch.setattr(R, "_near_entry", R._Near(lambda b: seen.append(1) or R._entry(b)))
    docs = [f"所在 東京都緑区\n甲区\n順位番号 1\n所有権移転\n受付 第{k}号\n所有者 佐藤一郎" for k in range(50)]
    out = next(R._record_batches(iter([pa.array([d + "\nx" * j for d in docs for j in range(8)])])))
    assert len(out) == 400 and len(seen) <= 2 * 50 and out[0].as_py()["owner"] == "佐藤一郎"


def test_election_reads_records_by_the_helper(spark, sf):
    """Readings went through the built-in functions, with diagnostics that no election reads."""
    columns = dict(catalogue._read(spark, sf).dtypes)
    assert columns["fields"] == R.RECORD


def test_readings_are_scored_and_read_by_one_helper(spark):
    """Four helpers passed each reading to Python and back; what they told is what the one tells."""
    from registry_jobs.functions import patterns as P
    from registry_jobs.functions import quality as Q
    from registry_jobs.operators import election as V
    from registry_jobs.plans import jobs

    sources = [*[s for s, _ in P.SOURCES], None, "nowhere"]
    rows = [(i, sources[i % len(sources)], t) for i, t in enumerate(texts(300))]
    readings = spark.createDataFrame([*rows, (10**6, "server", None), (10**6 + 1, "ocr-light", None)], "doc_id long, source string, raw_text string").repartition(4)
    want = V.candidate_set(readings).withColumn("quality", Q.text_quality(F.col("scored_text")))
    shown = lambda d: sorted((r[0] for r in d.select(F.to_json(F.struct(*want.columns), {"ignoreNullFields": "false"})).collect()))
    got = jobs.read_readings(readings)
    assert got.columns == [*want.columns, "fields"] and dict(got.dtypes) == dict(want.dtypes) | {"fields": R.RECORD}
    assert shown(got) == shown(want) == shown(jobs.scored_readings(readings))
    plain = ownership.extract_fields(want.select("doc_id", F.col("raw_text").alias("text"))).select("doc_id", *[f"fields.{n}" for n in (*R.FIELDS, "history")])
    a, b, c = ({r[0]: str(tuple(r)[1:]) for r in d.collect()} for d in (got.select("doc_id", "fields.*"), plain, jobs.with_fields(want).select("doc_id", "fields.*")))
    assert [(k, a[k], b[k], c[k]) for k in a if not a[k] == b[k] == c[k]] == [] and len(a) == len(b) == len(c)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_a_batch_writes_a_file_a_bucket(spark, tmp_path):
    """Rows dealt anyhow made a file for each bucket in each task."""
    from registry_jobs.streaming import arrivals as A

    df = spark.range(2000).selectExpr("id % 500 AS doc_id", "id AS n").repartition(8)
    for buckets in (3, 64):
        A.settle_batch(lambda d: d, lambda d: d.groupBy("doc_id").count(), str(tmp_path / str(buckets)), buckets)(df, 0)
        files = list((tmp_path / str(buckets) / "arrived").glob("batch=0/bucket=*/part-*"))
        assert len({f.parent for f in files}) == buckets and len(files) <= max(buckets, 3 * -(-2 * spark.sparkContext.defaultParallelism // 3))
        assert {r["count"] for r in A.settled(spark, str(tmp_path / str(buckets))).collect()} == {4}
        parts = A.dealt_by_bucket(df, buckets).rdd.glom().map(lambda rows: len({r.doc_id for r in rows})).collect()
        assert len(parts) >= 2 * spark.sparkContext.defaultParallelism and sum(parts) == 500 and max(parts) < 500


def test_quality_and_record_are_told_by_one_helper(spark):
    """Each reading went to Python twice, and the texts were written beside."""
    df = catalogue._read(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1 and "raw_text" not in df.columns
    both = lambda d: sorted(str(r) for r in d.select("doc_id", "source", "arrival_no", "quality").collect())
    assert both(df) == both(catalogue._scored(spark, "/root/testdata/sf0.001"))


def test_unit_ends_are_where_they_were():
    """The letter before a line end was looked at first, at each letter of a text."""
    from registry_jobs.functions import text as T

    now = T._unit_end().pattern
    solid = now[len("\n(?<=") : now.index("\n)(?=")]
    before = re.compile(f"(?<={solid})\n" + now[now.index("\n)(?=") + 2 :])
    assert [t for t in texts(400) if before.split(t or "") != T._unit_end().split(t or "")] == []
    assert sum(len(T._unit_end().split(t or "")) for t in texts(400)) > 5000
