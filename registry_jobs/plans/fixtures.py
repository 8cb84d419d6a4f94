"""Registry-like frames derived from the given tables by integer arithmetic, in Spark and as DuckDB text.

The tables hold no Japanese text. A customer becomes a document and each of the customer's orders an
ownership event; both forms below give equal rows, which a test asserts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.sources.tables import table, width

# Words the frames are made of.
EVENTS = ("所有権保存", "所有権移転", "所有権移転", "所有権一部移転", "持分一部移転", "所有権移転抹消", "所有権移転仮登記")
SURNAMES = ("佐藤", "鈴木", "高橋", "田中", "伊藤", "山本", "中村")
GIVEN = ("一郎", "花子", "健太", "美咲", "正雄")
COMPANIES = ("株式会社青空", "有限会社山川", "合同会社みどり")
BUILDER = "株式会社アーネストワン"
CAUSES = ("売買", "相続", "贈与")
PREFECTURES = ("東京都", "大阪府", "北海道", "福島県", "京都府")
CITIES = ("青葉市", "緑区", "桜町", "郡山市")
TOWNS = ("中央", "本町", "栄")


def _pick(words: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(n, F.lit(len(words))).cast("int"))


def _t(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _solid(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _owner(k: Column, shift: int = 0) -> Column:
    person = F.concat(_pick(SURNAMES, k + shift), _pick(GIVEN, k + shift))
    return F.when(k % 9 == 0, BUILDER).when(k % 5 == 0, _pick(COMPANIES, k)).otherwise(person) if not shift else person


def _entry_lines(k: Column, no: Column) -> Column:
    shared = (k % 7).isin(3, 4)
    holder = F.when(shared, "共有者").otherwise("所有者")
    full = _solid(
        _t("順位番号 ", no + 1),
        _pick(EVENTS, k),
        _t("受付 第", k % 9000 + 1000, "号"),
        _t("原因 令和", k % 5 + 1, "年", k % 12 + 1, "月", k % 28 + 1, "日", _pick(CAUSES, k)),
        F.when(k % 11 != 0, F.concat(holder, F.lit(" "), _owner(k))),
        F.when((k % 11 != 0) & (k % 4 == 0), F.concat(holder, F.lit(" "), _owner(k, 3))),
        F.when(shared & (k % 2 == 0), F.lit("持分 2分の1")),
    )
    return F.when(k % 13 == 0, F.array(_t("第", k % 900 + 100, "号"))).otherwise(full)


def reg_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one certificate for each customer with orders."""
    # few bytes make long texts: the number of partitions is said, as sizes would have the texts made in one task
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    sorted_keys = F.array_sort(F.collect_list("k"))
    by = orders.repartition(width(spark), "doc_id").groupBy("doc_id").agg(sorted_keys.alias("ks"))
    c = F.col("doc_id")
    place = F.concat(_pick(PREFECTURES, c), _pick(CITIES, c), _pick(TOWNS, c))
    area = _t(c % 400 + 50, ".", F.lpad((c % 100).cast("string"), 2, "0"), "㎡")
    title = _solid(
        F.when(c % 17 != 0, F.lit("表題部")),
        F.when(c % 6 == 1, F.lit("所在")).otherwise(F.concat(F.lit("所在 "), place)),
        F.when(c % 6 == 1, place),
        F.when(c % 8 == 3, F.lit("地図番号 A12")),
        F.when(c % 10 == 9, _t("地番 ", c % 999 + 1, "番", c % 50, " 地積 ", area)).otherwise(_t("地番 ", c % 999 + 1, "番", c % 50)),
        F.when(c % 10 != 9, F.concat(F.lit("地積 "), area)),
        F.when(c % 4 == 1, _t("床面積 ", c % 90 + 20, ".5㎡")),
    )
    head = _solid(F.when(c % 17 != 0, F.lit("権利部")), F.when(c % 19 == 0, F.lit("乙区")), F.when(c % 19 == 0, F.lit("抵当権設定")), F.lit("甲区"), F.when(c % 10 == 2, F.lit("順位番号 登記の目的 受付年月日")))
    tail = F.when(c % 3 == 0, F.array(*[F.lit(x) for x in ("乙区", "順位番号 1", "抵当権設定", "共同担保目録", "東京都外町 9番9の土地")])).otherwise(F.array().cast("array<string>"))
    events = F.flatten(F.transform("ks", _entry_lines))
    return by.select("doc_id", F.array_join(F.concat(title, head, events, tail), "\n").alias("text"))


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_pick(words: tuple[str, ...], n: str) -> str:
    return f"{_sql_list(words)}[({n}) % {len(words)} + 1]"


def _sql_owner(shift: int = 0) -> str:
    person = f"{_sql_pick(SURNAMES, f'k + {shift}')} || {_sql_pick(GIVEN, f'k + {shift}')}"
    return person if shift else f"CASE WHEN k % 9 = 0 THEN '{BUILDER}' WHEN k % 5 = 0 THEN {_sql_pick(COMPANIES, 'k')} ELSE {person} END"


_HOLDER = "(CASE WHEN k % 7 IN (3, 4) THEN '共有者' ELSE '所有者' END)"
REG_DOCS_SQL = f"""
fx_orders AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS no FROM orders),
fx_events AS (
    SELECT doc_id, k, CASE WHEN k % 13 = 0 THEN ['第' || (k % 900 + 100) || '号'] ELSE list_filter([
        '順位番号 ' || (no + 1), {_sql_pick(EVENTS, "k")}, '受付 第' || (k % 9000 + 1000) || '号',
        '原因 令和' || (k % 5 + 1) || '年' || (k % 12 + 1) || '月' || (k % 28 + 1) || '日' || {_sql_pick(CAUSES, "k")},
        CASE WHEN k % 11 <> 0 THEN {_HOLDER} || ' ' || ({_sql_owner()}) END,
        CASE WHEN k % 11 <> 0 AND k % 4 = 0 THEN {_HOLDER} || ' ' || ({_sql_owner(3)}) END,
        CASE WHEN k % 7 IN (3, 4) AND k % 2 = 0 THEN '持分 2分の1' END], lambda x: x IS NOT NULL) END AS ls
    FROM fx_orders),
fx_docs AS (SELECT doc_id, flatten(list(ls ORDER BY k)) AS ls FROM fx_events GROUP BY doc_id),
fx_place AS (
    SELECT doc_id, doc_id AS c, ls, {_sql_pick(PREFECTURES, "doc_id")} || {_sql_pick(CITIES, "doc_id")} || {_sql_pick(TOWNS, "doc_id")} AS place,
           (doc_id % 400 + 50) || '.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '㎡' AS area FROM fx_docs),
reg_docs AS (
    SELECT doc_id, array_to_string(list_concat(list_concat(list_concat(list_filter([
        CASE WHEN c % 17 <> 0 THEN '表題部' END, CASE WHEN c % 6 = 1 THEN '所在' ELSE '所在 ' || place END, CASE WHEN c % 6 = 1 THEN place END,
        CASE WHEN c % 8 = 3 THEN '地図番号 A12' END,
        CASE WHEN c % 10 = 9 THEN '地番 ' || (c % 999 + 1) || '番' || (c % 50) || ' 地積 ' || area ELSE '地番 ' || (c % 999 + 1) || '番' || (c % 50) END,
        CASE WHEN c % 10 <> 9 THEN '地積 ' || area END, CASE WHEN c % 4 = 1 THEN '床面積 ' || (c % 90 + 20) || '.5㎡' END,
        CASE WHEN c % 17 <> 0 THEN '権利部' END, CASE WHEN c % 19 = 0 THEN '乙区' END, CASE WHEN c % 19 = 0 THEN '抵当権設定' END, '甲区',
        CASE WHEN c % 10 = 2 THEN '順位番号 登記の目的 受付年月日' END], lambda x: x IS NOT NULL), ls),
        CASE WHEN c % 3 = 0 THEN ['乙区', '順位番号 1', '抵当権設定', '共同担保目録', '東京都外町 9番9の土地'] ELSE CAST([] AS VARCHAR[]) END), CAST([] AS VARCHAR[])), chr(10)) AS text
    FROM fx_place)"""

# What spoils a reading, by strength.
SPOILS = (("所有権移転", "所有権秘転"), ("所在", "所 在"), ("原因", "原囚"), ("5号", "S号"), ("地番", "地盤"))


def reg_docs_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, arrival_no, raw_text): eight readings of each certificate, spoiled by fixed rules."""
    docs = reg_docs(spark, sf_dir)
    sources = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("arrival_no")) for k, (s, _) in enumerate(P.SOURCES)])
    rows = docs.select("doc_id", "text", F.explode(sources).alias("s")).select("doc_id", "s.source", "s.arrival_no", "text")
    strength = F.pmod(F.col("doc_id") * 31 + F.col("arrival_no") * 7, F.lit(10))
    text = F.col("text")
    for k, (a, b) in enumerate(SPOILS):
        text = F.replace(text, F.when(strength > k, a).otherwise(""), F.lit(b))  # nothing is sought for an empty text; each step names the text once
    text = F.concat(text, F.when(strength > 6, "\nABCD EFGH IJKL\n%%% ===").otherwise(""))
    text = F.when(strength == 9, F.substring(text, 1, 60)).otherwise(text)
    return rows.select("doc_id", "source", "arrival_no", text.alias("raw_text"))


def _noisy_sql() -> str:
    steps = ["n0 AS (SELECT d.doc_id, s.source, s.arrival_no, (d.doc_id * 31 + s.arrival_no * 7) % 10 AS strength, d.text FROM reg_docs d CROSS JOIN (VALUES "]
    steps[0] += ", ".join(f"('{s}', {k})" for k, (s, _) in enumerate(P.SOURCES)) + ") s(source, arrival_no))"
    for k, (a, b) in enumerate(SPOILS):
        steps.append(f"n{k + 1} AS (SELECT * REPLACE (CASE WHEN strength > {k} THEN replace(text, '{a}', '{b}') ELSE text END AS text) FROM n{k})")
    last = len(SPOILS)
    steps.append(f"n{last + 1} AS (SELECT * REPLACE (CASE WHEN strength > 6 THEN text || chr(10) || 'ABCD EFGH IJKL' || chr(10) || '%%% ===' ELSE text END AS text) FROM n{last})")
    steps.append(f"reg_noisy AS (SELECT doc_id, source, arrival_no, CASE WHEN strength = 9 THEN substr(text, 1, 60) ELSE text END AS raw_text FROM n{last + 1})")
    return REG_DOCS_SQL + ",\n" + ",\n".join(steps)


REG_NOISY_SQL = _noisy_sql()


def reg_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, variant_no, source, page_text): each turn of a conversation as two pages in five variants, which break its whole text at different places."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("turn"), F.coalesce("text", F.lit("")).alias("t"))
    variants = F.array(*[F.struct(F.lit(k).alias("variant_no"), F.lit(s).alias("source")) for k, s in enumerate(P.VARIANTS)])
    v = turns.select("doc_id", "turn", "t", F.explode(variants).alias("v")).select("doc_id", "turn", "v.*", "t")
    n = F.col("doc_id") + F.col("turn") + F.col("variant_no")
    head = F.when(n % 4 == 0, "所在 地番 ").when(n % 4 == 1, "権利部 甲区 所有者 ").otherwise("")
    size = F.coalesce(F.get(F.array(*[F.lit(x) for x in (40, 90, 170, 230)]), F.pmod(n, F.lit(5)).cast("int")), F.length("t"))
    page = lambda k, text: F.struct((F.col("turn") * 2 + (k - 1)).cast("int").alias("page_no"), text.alias("page_text"))
    pages = F.array(page(0, F.concat(head, F.substring(F.col("t"), F.lit(1), size))), page(1, F.substring(F.col("t"), size + 1, F.length("t"))))
    return v.select("doc_id", "variant_no", "source", F.explode(pages).alias("p")).select("doc_id", "p.page_no", "variant_no", "source", "p.page_text")


_PAGE_N = "(conv_id + turn + 1 + v.variant_no)"
_PAGE_SIZE = f"coalesce([40, 90, 170, 230][{_PAGE_N} % 5 + 1], length(coalesce(text, '')))"
REG_PAGES_SQL = (
    "reg_pages AS (SELECT conv_id AS doc_id, CAST((turn + 1) * 2 + k.k - 1 AS INTEGER) AS page_no, v.variant_no, v.source, CASE WHEN k.k = 0 THEN "
    f"(CASE WHEN {_PAGE_N} % 4 = 0 THEN '所在 地番 ' WHEN {_PAGE_N} % 4 = 1 THEN '権利部 甲区 所有者 ' ELSE '' END) || substr(coalesce(text, ''), 1, {_PAGE_SIZE}) "
    f"ELSE substr(coalesce(text, ''), {_PAGE_SIZE} + 1) END AS page_text FROM conversations CROSS JOIN (VALUES (0), (1)) k(k) CROSS JOIN (VALUES "
    + ", ".join(f"({k}, '{s}')" for k, s in enumerate(P.VARIANTS))
    + ") v(variant_no, source))"
)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, r, g, b): each embedding's 64 numbers as an 8 x 8 picture."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v"))
    shade = lambda f: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("v").cast("double") * f + 128))).cast("int")
    return e.select("image_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), shade(500.0).alias("r"), shade(400.0).alias("g"), shade(300.0).alias("b"))


PIXELS_SQL = (
    "px AS (SELECT vec_id AS image_id, CAST(unnest(range(1, 65)) - 1 AS INTEGER) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), "
    "pixels AS (SELECT image_id, CAST(p // 8 AS INTEGER) AS y, p % 8 AS x, "
    + ", ".join(f"CAST(least(255, greatest(0, floor(v * {f} + 128))) AS INTEGER) AS {n}" for n, f in (("r", "500.0::DOUBLE"), ("g", "400.0::DOUBLE"), ("b", "300.0::DOUBLE")))
    + " FROM px)"
)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content_type, body): an event as a JSON submission, keys missing by turns."""
    k = F.col("event_id")
    text = F.concat(F.col("event_type"), F.lit(" 所在地番 "), F.repeat(F.lit("番"), (k % 30).cast("int")))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit('{"rawText": "'), text, F.lit('"}')))
        .when(k % 4 == 1, F.concat(F.lit('{"format": "csv", "fields": {"location": "'), text, F.lit('", "ownersHistory": ["a", "", "b"]}}')))
        .when(k % 4 == 2, F.lit('{"format": "xlsx", "fields": {"owner": "x", "ownersHistory": "none"}}'))
        .otherwise(F.lit("{}"))
    )
    kind = F.when(k % 5 == 0, "text/plain").when(k % 5 == 1, "multipart/form-data; x").otherwise("application/json")
    return table(spark, sf_dir, "events").select(k.alias("doc_id"), kind.alias("content_type"), F.when(k % 7 != 0, text).alias("text"), body.alias("body"))


_SUB_TEXT = "event_type || ' 所在地番 ' || repeat('番', CAST(event_id % 30 AS INTEGER))"
SUBMISSIONS_SQL = (
    "submissions AS (SELECT event_id AS doc_id, CASE WHEN event_id % 5 = 0 THEN 'text/plain' WHEN event_id % 5 = 1 THEN 'multipart/form-data; x' ELSE 'application/json' END AS content_type, "
    f"CASE WHEN event_id % 7 <> 0 THEN {_SUB_TEXT} END AS text, CASE WHEN event_id % 4 = 0 THEN '{{\"rawText\": \"' || {_SUB_TEXT} || '\"}}' "
    f"WHEN event_id % 4 = 1 THEN '{{\"format\": \"csv\", \"fields\": {{\"location\": \"' || {_SUB_TEXT} || '\", \"ownersHistory\": [\"a\", \"\", \"b\"]}}}}' "
    "WHEN event_id % 4 = 2 THEN '{\"format\": \"xlsx\", \"fields\": {\"owner\": \"x\", \"ownersHistory\": \"none\"}}' ELSE '{}' END AS body FROM events)"
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, the export fields, ownersHistory): a customer as a record, some fields blank."""
    c = F.col("c_custkey")
    blank = lambda n, x: F.when(c % n == 0, F.lit("")).when(c % n == 1, F.lit(None)).otherwise(x)
    return table(spark, sf_dir, "customer").select(
        c.alias("doc_id"),
        blank(5, F.concat(_pick(PREFECTURES, c), _pick(CITIES, c))).alias("location"),
        blank(7, _t(c % 99 + 1, "番")).alias("number"),
        blank(4, _t(c % 400 + 50, "㎡")).alias("area"),
        F.when(c % 3 == 0, "  ").otherwise(_t(c % 90, '"㎡')).alias("buildingArea"),
        blank(6, F.col("c_name")).alias("owner"),
        F.when(c % 8 == 0, F.array().cast("array<string>")).when(c % 8 == 1, F.lit(None)).otherwise(F.array(F.col("c_name"), F.lit(""), F.lit(None), F.col("c_mktsegment"))).alias("ownersHistory"),
    )


def _sql_blank(n: int, x: str) -> str:
    return f"CASE WHEN c % {n} = 0 THEN '' WHEN c % {n} = 1 THEN NULL ELSE {x} END"


RECORDS_SQL = (
    "cu AS (SELECT c_custkey AS c, c_name, c_mktsegment FROM customer), records AS (SELECT c AS doc_id, "
    f"{_sql_blank(5, _sql_pick(PREFECTURES, 'c') + ' || ' + _sql_pick(CITIES, 'c'))} AS location, {_sql_blank(7, chr(39) + chr(39) + ' || (c % 99 + 1) || ' + chr(39) + '番' + chr(39))} AS number, "
    f"{_sql_blank(4, '(c % 400 + 50) || ' + chr(39) + '㎡' + chr(39))} AS area, CASE WHEN c % 3 = 0 THEN '  ' ELSE (c % 90) || '\"㎡' END AS \"buildingArea\", {_sql_blank(6, 'c_name')} AS owner, "
    "CASE WHEN c % 8 = 0 THEN CAST([] AS VARCHAR[]) WHEN c % 8 = 1 THEN NULL ELSE [c_name, '', NULL, c_mktsegment] END AS \"ownersHistory\" FROM cu)"
)
