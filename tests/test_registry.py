"""Extraction on texts of our own, operators on edge rows, and the registered queries against their SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from registry_jobs.functions import predicates as C
from registry_jobs.functions import quality as Q
from registry_jobs.functions import text as T
from registry_jobs.operators import election as V
from registry_jobs.operators import events, images, ownership, sections, templates
from registry_jobs.plans import catalogue, jobs
from registry_jobs.sources import exports as E
from registry_jobs.streaming.arrivals import gated_extract, stream_extract

HEAD = "表題部\n所在 東京都青葉市緑町一丁目\n地番 12番3\n地積 123.45㎡\n権利部\n甲区\n"
PLAIN = HEAD + "順位番号 1\n所有権保存\n受付 第1234号\n原因 令和1年2月3日新築\n所有者 佐藤一郎"
# name, text, location, number, area, building area, owner
CASES = [
    ("plain", PLAIN, "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", "佐藤一郎"),
    ("building", PLAIN.replace("権利部", "床面積 88.20㎡\n権利部", 1), "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "88.20㎡", "佐藤一郎"),
    ("transfers", PLAIN + "\n順位番号 2\n所有権移転\n受付 第2345号\n原因 令和2年1月30日売買\n所有者 株式会社青空", "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", "株式会社青空"),
    ("cancelled", PLAIN + "\n順位番号 2\n所有権移転抹消\n受付 第2345号\n所有者 田中花子", "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", "佐藤一郎"),
    ("provisional", PLAIN + "\n順位番号 2\n所有権移転仮登記\n所有者 田中花子", "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", "佐藤一郎"),
    ("two owners", PLAIN + "\n順位番号 2\n所有権移転\n共有者 田中花子\n共有者 鈴木次郎", "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", "田中花子 / 鈴木次郎"),
    ("spaced, labels alone", "表 題 部\n所 在\n郡 山 市 緑 町\n地 番\n53=1\n地 積 88平方メートル\n権 利 部\n甲 区\n順位番号 1\n所 有 権 保 存\n所 有 者 佐 藤 一 郎", "郡山市緑町", "53-1", "88㎡", "", "佐藤一郎"),
    ("latin noise", "ABCD EFGH\nQWERTY UIOP\n%%% @@@ ===\nLOREM IPSUM", "", "", "", "", ""),
    ("mortgage and collateral", PLAIN + "\n乙区\n順位番号 1\n抵当権設定\n共同担保目録\n東京都外町 9番9の土地", "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", "佐藤一郎"),
    ("dangerous owner", HEAD + "順位番号 1\n所有権保存\n所有者 QQ%%@@ABC", "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", ""),
    ("one-line title", "表題部\n所在 東京都青葉市緑町 地番 7番 地積 45.00㎡\n権利部\n甲区\n順位番号 1\n所有権保存\n所有者 佐藤一郎", "東京都青葉市緑町", "7番", "45.00㎡", "", "佐藤一郎"),
    ("map number", PLAIN.replace("地番", "地図番号 A11-2\n地番", 1), "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", "佐藤一郎"),
    ("share after builder", HEAD + "順位番号 1\n所有権移転\n所有者 株式会社アーネストワン\n順位番号 2\n所有権一部移転\n共有者 鈴木次郎\n持分 3 8 分 の 1", "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", "共有者候補あり"),
    ("lone area", "表題部\n所在 東京都青葉市緑町\n5㎡\n権利部\n甲区", "東京都青葉市緑町", "", "", "", ""),
    ("no headings", "所在 東京都青葉市緑町\n所有者 佐藤一郎", "東京都青葉市緑町", "", "", "", "佐藤一郎"),
    ("mortgage first", HEAD.replace("甲区\n", "乙区\n抵当権設定\n甲区\n") + "順位番号 1\n所有権保存\n所有者 佐藤一郎", "東京都青葉市緑町一丁目", "12番3", "123.45㎡", "", "佐藤一郎"),
    ("null", None, "", "", "", "", ""),
    ("empty", "", "", "", "", "", ""),
    ("one letter", "所", "", "", "", "", ""),
]


@pytest.fixture(scope="module")
def extracted(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r.fields for r in ownership.extract_fields(df).select("doc_id", "fields").collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_case(extracted, i):
    f = extracted[i]
    assert (f.location, f.lot_number, f.land_area, f.building_area, f.owner) == CASES[i][2:]
    for item in f.history:
        assert not item.startswith("第") and not item[:1].isdigit()


def test_history_and_diagnostics(extracted):
    two = extracted[2]
    assert len(two.history) == 2 and "権利者: 佐藤一郎" in two.history[0] and "受付: 第2345号" in two.history[1]
    assert two.ownership_diagnostics[0] == "Kouku event count: 2" and two.ownership_diagnostics[-1] == "Assembled ownership state: 株式会社青空"
    assert all("田中花子" not in x for x in extracted[3].history)
    assert any("retained" in x for x in extracted[12].ownership_diagnostics) and "持分38分の1" in extracted[12].history[-1]
    assert "Collateral exclusion: found and excluded" in extracted[8].field_diagnostics
    assert "東京都外町" not in "".join(extracted[8].history)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.fold_chars(lit("１２m²｜\r　"))) == "12㎡㎡ \n "
    assert one(spark, T.join_digit_separators(lit("53=1 10:18"))) == "53-1 10-18"
    assert one(spark, T.collapse_ws(lit("1)  \n a"))) == "1 a"
    r = one(spark, T.repair_numbers(lit("受付 第2S48号\nS5 B\n持分 3 8 分 の 1")))
    assert (r.text, r.changed_lines) == ("受付 第2548号\nS5 B\n持分 38分の1", 2)
    assert one(spark, T.despace_lines(lit("所 在 東 京 1 2 番\na b"))) == "所在東京12番\na b"
    assert one(spark, T.clean_value(lit("・： （東京）【都】—x "))) == "東京 都 -x"
    assert one(spark, T.unique_clean(F.array(lit("a"), lit(" a"), lit(""), lit("b")))) == ["a", "b"]
    assert one(spark, T.clip_text(lit("x" * 5001)))[-10:] == "\n...（以下省略）"
    assert one(spark, T.js_trim(lit("　﻿x\n"))) == "x"


def test_counts_agree_with_text(spark):
    df = spark.createDataFrame([(c[1],) for c in CASES], "text string")
    rows = df.select(T.normalize_with_report(F.col("text")).alias("a"), T.normalize_ocr(F.col("text")).alias("b")).collect()
    assert all(r.a.text == r.b for r in rows)
    spaced = next(r.a.corrections for r, c in zip(rows, CASES, strict=True) if c[0] == "spaced, labels alone")
    assert spaced["所在空白補正"] == 2 and spaced["所有権空白補正"] == 2


def test_predicates(spark):
    lit = F.lit
    true = [C.is_noise_line(lit("aaaaaaaa")), C.is_noise_line(lit("%%")), C.looks_like_garbage(lit("hello world")), C.looks_like_garbage(lit("")), C.has_noise_token(lit("a@b"))]
    false = [C.is_noise_line(lit("東京")), C.looks_like_garbage(lit("東京都")), C.is_plausible(lit("�東京")), C.looks_like_person(lit("順位太郎")), C.ascii_noise(lit("東京都a緑町"))]
    assert spark.range(1).select(*[x.alias(str(k)) for k, x in enumerate(true)]).first() == (True,) * len(true)
    assert spark.range(1).select(*[x.alias(str(k)) for k, x in enumerate(false)]).first() == (False,) * len(false)
    assert one(spark, C.safe_owner(lit("佐藤一郎 持分2分の1"))) == "佐藤一郎" and one(spark, C.safe_owner(lit("東京都港区一丁目"))) == ""
    assert one(spark, C.safe_area(lit("地積 88 平方メートル"))) == "88㎡" and one(spark, C.safe_number(lit("12番3"))) == "12番3"
    assert one(spark, C.safe_owner(lit("𠮷田太郎"))) == "𠮷田太郎"


def blocks(spark, *names):
    made = F.array(*[F.array(*[F.lit(x) for x in n]) for n in names])
    return one(spark, events.merge_receipt_blocks(made))


def test_receipt_blocks_do_not_cascade(spark):
    assert blocks(spark, ["第1号"], ["第2号"], ["第3号"], ["x"]) == [["第1号", "第2号"], ["第3号", "x"]]
    assert blocks(spark, ["x"], ["第1号"]) == [["x"], ["第1号"]] and blocks(spark, ["第1号"], ["x"]) == [["第1号", "x"]]


def test_replay_forms_agree(spark, sf):
    parsed = ownership.with_lines(catalogue.X.reg_docs(spark, sf))
    a = parsed.select("doc_id", ownership.replay(F.col("entries"))["owner"].alias("owner"))
    b = ownership.replay_rows(events.entry_rows(parsed))
    assert a.join(b.withColumnRenamed("owner", "o"), "doc_id").where("owner <> o").count() == 0


def test_quality(spark):
    q = one(spark, Q.text_quality(F.lit("表題部\n所 在 東京\nABCD EFGH IJKL")))
    assert (q.label_count, q.garbage_lines, q.length, q.line_count) == (2, 1, 19, 3)
    assert math.isclose(q.score, 19 / 6 + 7 / 19 * 80 + 44 - 12 / 19 * 35 - 24 - 15)
    assert one(spark, Q.text_quality(F.lit(None).cast("string"))).score == 0


def test_election(spark):
    rows = [(1, s, t) for s, t in (("text-layer", "ABCD EFGH IJKL MNOP"), ("ocr-original", PLAIN.replace("地積 123.45㎡", "")), ("ocr-binary", PLAIN))] + [(2, "server", "xx")]
    got = {r.doc_id: r for r in jobs.readings_to_record(spark.createDataFrame(rows, "doc_id long, source string, raw_text string")).collect()}
    assert got[1].accepted and got[1].fields.owner == "佐藤一郎" and got[1].fields.land_area == "123.45㎡"
    assert "採用元: OCR 標準" in got[1].reasons[0] and "採用元: OCR 白黒補正" in got[1].reasons[2]
    assert not got[2].accepted and got[2].warning and got[2].fields.owner == ""


def test_confirmed(spark):
    ok = lambda f, v: one(spark, V.is_confirmed(f, F.lit(v)))
    assert ok("lot_number", "12番3") and not ok("lot_number", "12") and ok("land_area", "10㎡") and not ok("land_area", "9㎡") and ok("building_area", "9㎡")
    assert not ok("owner", "共有者候補あり原因") and ok("owner", "佐藤一郎") and not ok("owner", "青空会社") and not ok("location", "緑") and not ok("owner", None)


def test_exports(spark):
    df = E.normalize_fields(spark.createDataFrame([(1, None, "1番", '5"㎡', " ", "佐藤", ["a", "", None, "b"], "raw", ["d"]), (2, "x", "", "", "", "", None, "raw", ["d"])], "doc_id int, location string, number string, area string, buildingArea string, owner string, ownersHistory array<string>, raw string, diagnostics array<string>"))
    rows = [tuple(r)[2:] for r in E.csv_report(df).where("doc_id = 1").orderBy("row_no").collect()]
    assert rows[0] == ("項目", "値") and rows[2] == ("所在地", "未検出") and rows[5][1] == "未検出" and rows[6] == ("持ち主の流れ", "a / b") and len(rows) == 7
    text = E.csv_text(df).where("doc_id = 1").first().csv_text
    assert text.startswith("﻿\"項目\",\"値\"\n") and '"5""㎡"' in text and "raw" not in text
    assert [r.value for r in E.workbook_tables(df)[1].where("doc_id = 2").orderBy("row_no").collect()] == ["持ち主の流れ", "未検出"]
    assert E.export_columns(df).columns == ["doc_id", "location", "number", "area", "buildingArea", "owner", "ownersHistory"]
    accepted, rejected = E.split_rejects(spark.createDataFrame([("application/json", "短"), ("multipart/form-data", None), ("text/plain", "x" * 30), ("application/json", "x" * 30)], "content_type string, text string"))
    assert accepted.count() == 1 and {r.reason for r in rejected.collect()} == {E.TOO_LITTLE_JSON, E.NO_FILE, E.BAD_TYPE}


def test_csv_files_read_back(spark, tmp_path):
    df = E.normalize_fields(spark.createDataFrame([(1, 'a "quoted", place', "1番", None, None, "佐藤", ["x", "y"])], "doc_id int, location string, number string, area string, buildingArea string, owner string, ownersHistory array<string>"))
    E.write_csv_reports(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), escape='"', schema="doc_id int, row_no int, item string, value string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, E.csv_report(df).collect())) and back.where("row_no = 2").first().value == 'a "quoted", place'


def test_read_pages(spark, tmp_path):
    spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id long, page_no long, page_text string").write.json(str(tmp_path / "p"))
    got = E.read_pages(spark, str(tmp_path / "p"), "json")
    assert got.columns == ["doc_id", "page_no", "source", "page_text"] and V.assemble_documents(got).first().text == "a\nb"


def test_templates_are_filled_once(spark):
    r = spark.createDataFrame([(1, "{{owner}}", "x")], "doc_id int, propertyName string, owner string")
    for k in templates.KEYS:
        if k not in r.columns:
            r = r.withColumn(k, F.lit(None).cast("string"))
    t = spark.createDataFrame([("a", "A", "{{propertyName}}-{{nothing}}-{{ owner }}", "{{owner}}{{owner}}")], "template string, label string, subject string, body string")
    got = templates.apply_templates(r, t).first()
    assert (got.subject, got.body) == ("{{owner}}--{{ owner }}", "xx")
    assert templates.template_catalogue(spark).count() == 3


def test_image_forms_agree(spark):
    r = np.random.default_rng(4)
    pics = {i: r.integers(0, 256, (9, 11), dtype=np.uint8) for i in range(4)} | {4: np.full((9, 11), 255, np.uint8), 5: np.zeros((9, 11), np.uint8)}
    px = spark.createDataFrame([(i, y, x, *[int(p[y, x])] * 3) for i, p in pics.items() for y in range(9) for x in range(11)], "image_id int, y int, x int, r int, g int, b int")
    grey = images.tone_map(px, *images.TONES["binary"])
    bw = images.binarize_despeckle(grey, images.otsu_threshold(grey))
    box = {b.image_id: b for b in images.auto_crop(bw.withColumnRenamed("value", "grey"), 1).collect()}
    value = {(p.image_id, p.y, p.x): p.value for p in bw.collect()}
    whole = spark.createDataFrame([(i, 11, 9, bytearray(p.tobytes())) for i, p in pics.items()] + [(9, 3, 3, None)], "image_id long, width int, height int, gray binary")
    for g in images.clean_images(whole, "binary", 1).collect():
        if g.image_id == 9:
            assert g.gray is None
            continue
        b = box[g.image_id]
        want = bytes(value[g.image_id, y, x] for y in range(b.top, b.bottom + 1) for x in range(b.left, b.right + 1))
        assert bytes(g.gray) == want and (g.height, g.width) == (b.bottom - b.top + 1, b.right - b.left + 1)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream_extract(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
    a, b = spark.read.parquet(str(tmp_path / "out")), gated_extract(docs)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    stream_extract(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == b.count()


def plain(v):
    return "None" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in "customer orders events documents embeddings conversations".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_queries_without_sql_run(spark, sf):
    for name in ("b13_correction_report", "b16_normalize_with_report", "h8_candidate_set", "k_clean_images", "l1_correction_totals"):
        assert catalogue.queries()[name](spark, sf).count() > 0


def test_reports_and_reasons_use_all_readings(spark, sf, monkeypatch):
    eight = catalogue.X.reg_docs_noisy(spark, sf).where("doc_id < 40").cache()
    monkeypatch.setattr(catalogue.X, "reg_docs_noisy", lambda s, d: eight)
    read = {(r.doc_id, r.source): r.n for r in eight.select("doc_id", "source", T.normalize_with_report(F.col("raw_text")).alias("n")).collect()}
    made = {(r.doc_id, r.source): r.text for r in catalogue.queries()["b16_normalize_with_report"](spark, sf).collect()}
    assert len(made) == len(catalogue.P.SOURCES) * len({d for d, _ in made}) and made == {k: r.text for k, r in read.items()}
    tops = {(k, n + 1, *x) for k, r in read.items() for n, x in enumerate(sorted(r.corrections.items(), key=lambda x: (-x[1], x[0]))[:12])}
    assert {((r.doc_id, r.source), r.rank, r.label, r["count"]) for r in catalogue.queries()["b13_correction_report"](spark, sf).collect()} == tops
    reasons = {r.doc_id: r.reasons for r in catalogue.queries()["i2_field_reasons"](spark, sf).collect()}
    assert reasons == {r.doc_id: " | ".join(r.reasons) for r in jobs.readings_to_record(eight).collect()}
    two = {r.doc_id: " | ".join(r.reasons) for r in jobs.readings_to_record(eight.where("arrival_no in (0, 2)")).collect()}
    assert reasons.keys() == two.keys() and reasons != two
