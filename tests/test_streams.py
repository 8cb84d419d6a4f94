"""Streams that cross rows, against the batch forms; a replayed batch changes nothing; mergeable counts."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.operators import corpus
from registry_jobs.operators import election as V
from registry_jobs.plans import fixtures as X
from registry_jobs.plans import jobs
from registry_jobs.streaming import arrivals as A


def as_text(df):
    cols = sorted(df.columns)
    return sorted(str([r[c] for c in cols]) for r in df.collect())


@pytest.fixture(scope="module")
def readings(spark, sf):
    return spark.createDataFrame(X.reg_docs_noisy(spark, sf).where("doc_id < 30").select("doc_id", "source", "raw_text").collect(), A.READINGS)


def replay(checkpoint):
    """Forget that the last batch was committed."""
    last = max((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


def test_elected_stream_equals_batch(spark, readings, tmp_path):
    at = {n: str(tmp_path / n) for n in ("in", "out", "cp")}
    readings.repartition(3, F.xxhash64("source", "doc_id")).write.parquet(at["in"])
    run = lambda: A.stream_elect(spark, at["in"], at["out"], at["cp"], files_per_batch=1).awaitTermination(900)
    run()
    assert len([d for d in os.listdir(f"{at['out']}/settled") if d.startswith("batch=")]) == 3
    want = as_text(jobs.readings_to_record(readings))
    assert as_text(A.settled(spark, at["out"])) == want
    shutil.rmtree(f"{at['out']}/settled/batch=2")  # lost with the commit
    replay(at["cp"])
    run()
    assert as_text(A.settled(spark, at["out"])) == want


def test_late_pages_settle_their_documents_only(spark, tmp_path):
    rows = [(d, p, s, f"{s}{d}.{p}") for d in range(40) for s in ("a", "b") for p in (1, 2, 3)]
    pages = spark.createDataFrame(rows, A.PAGES)
    at = {n: str(tmp_path / n) for n in ("in", "out", "cp")}
    pages.where("page_no <> 2").repartition(1).write.parquet(at["in"])
    run = lambda: A.stream_assemble(spark, at["in"], at["out"], at["cp"]).awaitTermination(300)
    run()
    pages.where("page_no = 2 and doc_id < 5").repartition(1).write.mode("append").parquet(at["in"])
    run()
    assert {r.doc_id for r in spark.read.parquet(f"{at['out']}/settled/batch=1").collect()} == set(range(5))
    want = V.assemble_documents(pages.where("page_no <> 2 or doc_id < 5"), ("doc_id", "source"))
    assert as_text(A.settled(spark, at["out"])) == as_text(want)
    replay(at["cp"])
    run()
    assert as_text(A.settled(spark, at["out"])) == as_text(want)


def test_counts_merge_over_batches(spark, readings, tmp_path):
    at = {n: str(tmp_path / n) for n in ("in", "out", "cp")}
    texts = readings.select("doc_id", F.col("raw_text").alias("text"))
    texts.repartition(3, F.xxhash64("text", "doc_id")).write.parquet(at["in"])
    run = lambda: A.stream_corrections(spark, at["in"], at["out"], at["cp"], files_per_batch=1).awaitTermination(300)
    run()
    replay(at["cp"])
    run()
    merged = {r.label: (r.corrections, r.documents) for r in corpus.merged_corrections(spark.read.parquet(at["out"])).collect()}
    exact = {r.label: (r.corrections, r.documents) for r in jobs.corpus_report(texts).collect()}
    assert merged == exact  # sketches of a few documents are exact


def test_documents_are_counted_once_and_sketches_are_near(spark):
    df = spark.range(300_000).select((F.col("id") % 7 % 4).alias("part"), (F.col("id") % 100_000).alias("doc_id"), F.create_map(F.lit("a"), F.lit(2), F.when(F.col("id") % 2 == 0, "b").otherwise("c"), F.lit(1)).alias("corrections"))
    exact = {r.label: tuple(r)[1:] for r in corpus.correction_totals(df).collect()}
    assert exact == {"a": (600_000, 100_000), "b": (150_000, 50_000), "c": (150_000, 50_000)}
    parts = [corpus.correction_partials(df.where(F.col("part") == k)) for k in range(4)]
    merged = corpus.merged_corrections(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    for r in merged.collect():
        assert r.corrections == exact[r.label][0] and abs(r.documents / exact[r.label][1] - 1) < 3 * 0.0083


def test_counts_of_distinct_batches_add_up(spark, readings):
    scored = jobs.scored_readings(readings)
    halves = [corpus.source_and_tier_counts(scored.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    assert as_text(corpus.merged_counts(halves[0].unionByName(halves[1]), ["source", "tier"])) == as_text(corpus.source_and_tier_counts(scored))


def test_one_exchange_elects(spark, readings, tmp_path):
    """After the candidates are written one exchange on doc_id gives records with provenance and reasons."""
    jobs.read_readings(readings).write.parquet(str(tmp_path / "c"))
    candidates = spark.read.parquet(str(tmp_path / "c"))
    plan = jobs.with_reasons(V.elect(candidates))._jdf.queryExecution().sparkPlan().toString()
    full = jobs.with_reasons(V.elect(candidates))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in full and "Window" not in full and full.count("Exchange hashpartitioning(doc_id") == 1 and "had_owner" in plan


def test_election_of_odd_readings(spark):
    """Null texts, an unknown source and readings that repeat give a record all the same."""
    rows = [(1, "server", None), (1, "pdf", ""), (2, "nowhere", "所在 東京都緑区中央"), (3, P.SOURCES[0][0], "x"), (3, P.SOURCES[0][0], "x")]
    got = jobs.readings_to_record(spark.createDataFrame(rows, A.READINGS))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3]
    assert jobs.readings_to_record(spark.createDataFrame([], A.READINGS)).count() == 0


def test_batches_of_few_files_are_dealt_over_all_cores(spark):
    from registry_jobs.streaming.arrivals import dealt

    cores = spark.sparkContext.defaultParallelism
    few = spark.range(100).coalesce(1)
    assert dealt(few).rdd.getNumPartitions() >= cores and sorted(r.id for r in dealt(few).collect()) == list(range(100))
    many = spark.range(0, 100, 1, 3 * cores)
    assert dealt(many) is many
