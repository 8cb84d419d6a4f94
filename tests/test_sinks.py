"""Text files, broken records, counts while writing, and exports of one document alone."""

import os

import pytest
from pyspark.sql import functions as F

from registry_jobs.sources import exports as E

RECORD = "doc_id long, location string, number string, area string, buildingArea string, owner string, ownersHistory array<string>"


def test_text_files(spark, tmp_path):
    for name, text in (("a-12.txt", "一行目\r\n二行目\n"), ("sub/page7.txt", "x"), ("none.txt", "no digits")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    got = {r.doc_id: r.text for r in E.read_texts(spark, str(tmp_path)).collect()}
    assert got == {12: "一行目\r\n二行目\n", 7: "x", None: "no digits"}


def test_broken_records_are_rejected_as_such(spark, tmp_path):
    lines = ['{"doc_id": 1, "content_type": "application/json", "text": "' + "字" * 30 + '"}', '{"doc_id": 2, "content', "not json", '{"doc_id": 3, "content_type": "text/plain"}', '{"doc_id": 4, "content_type": "application/json", "text": "短"}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    accepted, rejected = E.split_rejects(E.read_submissions(spark, str(tmp_path)).cache())
    assert [r.doc_id for r in accepted.collect()] == [1]
    assert {(r.doc_id, r.broken, r.reason) for r in rejected.collect()} == {(None, lines[1], E.BROKEN), (None, "not json", E.BROKEN), (3, None, E.BAD_TYPE), (4, None, E.TOO_LITTLE_JSON)}


@pytest.mark.parametrize("keep", [False, True])
def test_counts_are_seen_while_rows_pass(spark, tmp_path, keep):
    rows = [(i, "application/json", "字" * 30 if i % 3 else "短") if i % 4 else (i, "text/plain", None) for i in range(1000)]
    reads = spark.sparkContext.accumulator(0)

    def once(x):
        reads.add(1)
        return x

    df = spark.createDataFrame(rows, "doc_id long, content_type string, text string").withColumn("doc_id", F.udf(once, "long")("doc_id"))
    counts = E.write_accepted(df, str(tmp_path / "a"), str(tmp_path / "all") if keep else None)
    want = {r.reason or "accepted": r["count"] for r in E.judged(spark.createDataFrame(rows, "doc_id long, content_type string, text string")).groupBy("reason").count().collect()}
    assert counts == want and reads.value == 1000
    kept = spark.read.parquet(str(tmp_path / "all")).where("accepted = 'true'") if keep else spark.read.parquet(str(tmp_path / "a"))
    assert kept.count() == want["accepted"]


def stamps(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_one_document_is_exported_again_alone(spark, tmp_path):
    rows = [(i, f"東京都{i}", "1番", None, '5"㎡', "佐藤", ["a", "b"]) for i in range(300)]
    df = E.normalize_fields(spark.createDataFrame(rows, RECORD))
    for export, name in ((E.export_documents, "csv"), (E.export_workbooks, "tables")):
        export(df, str(tmp_path / name))
    before = stamps(tmp_path)
    assert len(before) == 300 * 3
    changed = E.normalize_fields(spark.createDataFrame([(17, "大阪府", "2番", None, None, "鈴木", None)], RECORD))
    E.export_documents(changed, str(tmp_path / "csv"))
    E.export_workbooks(changed, str(tmp_path / "tables"))
    after = stamps(tmp_path)
    assert {os.path.dirname(p) for p in before if after.get(p) != before[p]} == {os.path.dirname(p) for p in after if p not in before}
    assert {p.split("doc_id=")[1].split("/")[0] for p in after if p not in before} == {"17"} and len(after) == len(before)
    texts = {r.doc_id: r.csv_text for r in E.csv_text(changed.unionByName(df.where("doc_id <> 17"))).collect()}
    for i in (0, 17, 299):
        file = next((tmp_path / "csv" / f"doc_id={i}").glob("part-*"))
        assert file.read_bytes().decode() == texts[i] + "\n" and file.read_bytes().startswith(b"\xef\xbb\xbf")
    sheets = spark.read.parquet(str(tmp_path / "tables")).where("doc_id = 17")
    assert {(r.sheet, r.row_no, r.value) for r in sheets.collect()} >= {("概要", 1, "鈴木"), ("履歴", 0, "持ち主の流れ"), ("履歴", 1, "未検出")}


def test_submissions_keep_their_own_columns(spark):
    df = spark.createDataFrame([(1, "x", "y", '{"rawText": "t", "format": "csv"}')], "doc_id long, p string, row string, body string")
    got = E.parse_submissions(df).first()
    assert (got.p, got.row, got.raw_text, got.format, got.fields.owner) == ("x", "y", "t", "csv", "")


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    """As many listing tasks as there are folders were started before."""
    from registry_jobs.sources.exports import read_exports
    from registry_jobs.sources.tables import LISTING

    spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS value").repartition(1).write.partitionBy("doc_id").text(f"{tmp_path}/out")
    before, sc = spark.conf.get(LISTING), spark.sparkContext
    sc.setJobGroup("listing", "listing")
    found = read_exports(spark, f"{tmp_path}/out")
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert sum(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * sc.defaultParallelism
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(LISTING) == before and found.count() == 200


def test_exports_are_written_by_many_tasks(spark, tmp_path):
    from registry_jobs.plans import fixtures

    E.export_documents(E.normalize_fields(fixtures.records(spark, "/root/testdata/sf0.001")), f"{tmp_path}/out")
    parts = {f.name.split("-")[1] for f in tmp_path.glob("out/*/part-*")}
    assert len(parts) > 1


def test_own_files_are_what_sparks_reader_and_writer_have(spark, tmp_path):
    """Odd names, hidden and compressed files; null, repeated and odd ids. Nothing is written or read by Spark's file index."""
    import gzip

    from registry_jobs.sources.files import read_files

    at = tmp_path / "in"
    for name in ("a 1.txt", "é%ü-2.txt", "sub/_x=3/b[4].txt", "sub/deep/c#5.txt", "_hid/6.txt", ".7.txt", "_8.txt", "empty9.txt", "sub/全 角-10.txt"):
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(b"" if "empty" in name else name.encode() + b"\r\n\xff\n")
    seen = lambda df: sorted((r.file, bytes(r.b), r.doc_id) for r in df.select("file", F.col("text").cast("binary").alias("b"), "doc_id").collect())
    spark_has = spark.read.option("recursiveFileLookup", "true").text(str(at), wholetext=True)
    want = sorted((r.f, bytes(r.b)) for r in spark_has.select(F.col("_metadata.file_path").alias("f"), F.col("value").cast("binary").alias("b")).collect())
    assert read_files(spark, str(at)) is not None and [x[:2] for x in seen(E.read_texts(spark, f"file://{at}"))] == want
    (at / "z11.txt.gz").write_bytes(gzip.compress(b"packed"))
    assert read_files(spark, str(at)) is None and any(x[1:] == (b"packed", 11) for x in seen(E.read_texts(spark, str(at))))

    rows = [(None, "null"), ("5", "a"), ("5", "b"), ("6", None), ("x/y=z", "odd"), ("", "none")]
    df = spark.createDataFrame(rows, "doc_id string, value string")
    E.write_texts(df, str(tmp_path / "ours"))
    df.repartition(4, "doc_id").sortWithinPartitions("doc_id").write.partitionBy("doc_id").text(str(tmp_path / "sparks"))
    held = lambda n: sorted((f.parent.name, f.read_bytes()) for f in (tmp_path / n).glob("doc_id=*/part-*"))
    one_file = lambda found: {d: sorted(b"".join(t for e, t in found if e == d).split(b"\n")) for d, _ in found}
    assert one_file(held("ours")) == one_file(held("sparks")) and len(held("ours")) <= len(held("sparks"))
    assert (tmp_path / "ours" / "_SUCCESS").exists() and not [f for f in os.listdir(tmp_path / "ours" / "doc_id=5") if f.startswith(".")]
    assert {r.doc_id for r in E.read_exports(spark, str(tmp_path / "ours")).collect()} == {None, "5", "6", "x/y=z"}  # odd ids: by Spark's reader


def test_a_failed_export_leaves_what_was_there(spark, tmp_path):
    E.write_texts(spark.range(50).selectExpr("id AS doc_id", "'old' AS value"), str(tmp_path / "out"))
    broken = spark.range(50).selectExpr("id AS doc_id", "if(id = 49, raise_error('no'), 'new') AS value")
    with pytest.raises(Exception, match="no"):
        E.write_texts(broken, str(tmp_path / "out"))
    assert {r.value for r in E.read_exports(spark, str(tmp_path / "out")).collect()} == {"old\n"}
    E.write_texts(spark.createDataFrame([(7, "new")], "doc_id long, value string"), str(tmp_path / "out"))
    assert sorted((r.doc_id, r.value) for r in E.read_exports(spark, str(tmp_path / "out")).collect()) == [(i, "new\n" if i == 7 else "old\n") for i in range(50)]


def test_files_are_listed_by_tasks_each_once(spark, tmp_path):
    """All names passed through the driver, and a folder of folders was one task's."""
    from registry_jobs.sources import files as W

    names = {f"top/a{i % 5}/b{i % 70}/{i}.txt" for i in range(700)} | {f"top/{i}.txt" for i in range(9)} | {"alone.txt", "top/a1/c.txt"}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = W._listed(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in found) == sorted(f"{tmp_path}/{n}" for n in names)
    share = [len(list(W._dealt(str(tmp_path), W._levels(str(tmp_path), 32), lambda p, k=k: W.zlib.crc32(p.encode()) % 4 == k))) for k in range(4)]
    assert sum(share) == len(names) and min(share) > 0 and max(share) < len(names) / 2
    assert W.read_files(spark, str(tmp_path)).where("path like '%c.txt'").first().value == "top/a1/c.txt"
    (tmp_path / "none").mkdir()
    assert W.read_files(spark, str(tmp_path / "none")).count() == 0
