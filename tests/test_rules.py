"""Each fixed rule against examples of its own, and the guarded replacements against plain ones."""

import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions import predicates as C
from registry_jobs.functions import quality as Q
from registry_jobs.functions import text as T

# What each vocabulary rule must make of a text, written down by hand: before, after.
WORDS = """所有權 所有権 | 所 有 權 所有権 | 所有権一部移云 所有権一部移転 | 所有権秘転 所有権移転 | 所 有 権 秘 転 所有権移転 | 所有権移云 所有権移転 | 所 有 権 移 転 所有権移転
所 有 権 所有権 | 所有省 所有者 | 所 有 省 所有者 | 能利者 権利者 | 能 利 者 権利者 | 権刑者 権利者 | 権 利 者 そ の 他 の 事 項 権利者その他事項 | 権 利 者 権利者 | 共 有 者 共有者
原 因 原因 | 原囚 原因 | 原回 原因 | 順 位 番 号 順位番号 | 遷委番号 順位番号 | 受 付 年 月 日 受付年月日 | 受人年月日 受付年月日 | 受人年月 受付年月日 | 受 付 番 号 受付番号 | 受信 受付
登 記 の 目 的 登記の目的 | 登記の日的 登記の目的 | 事頂 事項 | 事通 事項 | 抵 当 挫 抵当権 | 抵当拍者 抵当権者 | 共同#保 共同担保 | 共同＃保 共同担保 | 担人の目的 担保の目的
地 図 帯 号 地図番号 | 地図帯呈 地図番号 | 令大 令和 | 信和 令和 | 令衝 令和 | 売質 売買 | 売 買 売買 | 売暫 売買 | 沈質 売買 | 大機町 大槻町 | 大横町 大槻町 | 茶山下 葉山下
都山市 郡山市 | 都市市 郡山市 | 都市山 郡山市 | 都市 郡山市 | 部山市 郡山市 | 前山市 郡山市 | 拓貼市 郡山市 | 林式会社 株式会社 | 床攻会社 株式会社 | アー ネ ス ト ワン アーネストワン
アーネス トワン アーネストワン | アー ネスト ワン アーネストワン | 所 在 所在 | 所奉 所在 | 所夫 所在 | 填地の表示 土地の表示 | 地の表示 土地の表示 | 地 番 地番 | 地 積 地積 | 床 面 積 床面積
建 物 面 積 建物面積 | 表 題 部 表題部 | 権 利 部 権利部 | 甲 区 甲区 | 甲區 甲区 | 乙 区 乙区 | 乙區 乙区"""
# The same for labels.
LABELS = """表 題 部=表題部 表題都=表題部 表題郡=表題部 表題部(土地)=表題部 填地の表示=土地の表示 地の表示=土地の表示 権 利 部=権利部 甲 區=甲区 甲區=甲区 乙 區=乙区 乙區=乙区 所 邊=所在 所辺=所在 所 在=所在 所在地=所在
所奉=所在 所夫=所在 地 番=地番 地盤=地番 地香=地番 地 積=地積 地績=地積 地責=地積 床 面 積=床面積 床面 積=床面積 建 物 面 積=建物面積 権 利 者=権利者その他事項 権利者その他の事項=権利者その他事項 所 有 者=所有者
所有 者=所有者 抹 消=抹消 変 更=変更 仮 登 記=仮登記 仮登記=仮登記 更 正=更正 持 分=持分 原 因=原因"""


def pairs():
    for one in re.split(r"\s*\|\s*|\n", WORDS):
        before, after = one.rsplit(" ", 1)
        yield before, after


def label_pairs():
    for before, after in re.findall(r"(\S[^=\n]*?)=(\S+)", LABELS):
        yield before.strip(), after


def test_vocabulary_rules(spark):
    rows = list(pairs())
    assert len(rows) > 60
    got = spark.createDataFrame([(b, a) for b, a in rows], "b string, a string").select("b", "a", T.apply_vocabulary_text(F.concat(F.lit("x "), "b", F.lit(" y"))).alias("x")).collect()
    assert {(r.b, r.x) for r in got if r.x != f"x {r.a} y"} == set()
    got = spark.createDataFrame(list(label_pairs()), "b string, a string").select("b", "a", T.normalize_labels(F.col("b")).alias("x")).collect()
    assert {(r.b, r.x) for r in got if r.x != r.a} == set() and len(got) > 35


def test_guards_change_nothing(spark):
    """Texts of pieces of the rules, with and without white space inside: as a plain chain of replacements makes them."""
    r = random.Random(2)
    pieces = sorted({c for v, _, *_ in (*P.VOCABULARY, *P.LABEL_RULES) for c in re.sub(r"[_*?.|\[\]\\]", "", v)})
    words = [re.sub(r"[\[(].*", "", one) for v, _, *_ in (*P.VOCABULARY, *P.LABEL_RULES) for one in v.split("|")]
    texts = []
    for _ in range(1500):
        parts = [r.choice(words).replace("_", r.choice(["", " ", "\n", "　", "  "])) if r.random() < 0.7 else r.choice(pieces) for _ in range(r.randrange(1, 12))]
        texts.append(r.choice(["", " ", "\n"]).join(parts))

    def plain(text, rules):
        for variants, term, *_ in rules:
            text = re.sub(P.python_pattern(P.spaced(variants)), term, text)
        return text

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for apply, rules in ((T.apply_vocabulary_text, P.VOCABULARY), (T.normalize_labels, P.LABEL_RULES)):
        assert {(x.t, x.x) for x in df.select("t", apply(F.col("t")).alias("x")).collect()} == {(t, plain(t, rules)) for t in texts}


def test_units_of_lines_change_nothing(spark):
    """The normaliser works on units of lines and keeps what it made of them: as the column functions make the whole texts."""
    r = random.Random(5)
    words = [re.sub(r"[\[(].*", "", one) for v, _, *_ in (*P.VOCABULARY, *P.LABEL_RULES) for one in v.split("|")]
    odd = ["", " ", "\u3000", "\r", "|", "｜", "12", "３", "=", ":", "5)", ")", "第1 2号", "地番 S5O", "都山市", "所在", "所", "在", "m²", "ABCD efgh", "\u2028", "表題部(x)", "表題部 (a", "b)", "原", "因", "持", "分", "1 2分 の 3", "順", "位"]
    texts = ["", " ", "\n", "所\n在", "1\n=\n2", "受信\n年月日", "所奉\n都山市\n所在\n都山市"]
    for _ in range(2500):
        parts = [r.choice(words).replace("_", r.choice(["", " ", "\n", "　"])) if r.random() < 0.5 else r.choice(odd) for _ in range(r.randrange(1, 14))]
        texts.append("".join(x + r.choice(["", " ", "\n", "\n", "\n\n", "\n \n"]) for x in parts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ocr = T.finish_text(T.chain_text(T.despace_lines(T.chain_text(T.front(F.col("t"))))))
    # made whole texts: the counts by the helper that the SQL function is
    first = T.vocabulary_chain(T.front(F.col("t")))
    plain = df.select("t", ocr.alias("o")).select("t", "o", T.label_text(F.col("o")).alias("n"))
    counted = df.select("t", first.alias("a")).select("t", "a", T.vocabulary_chain(T.despace_lines(F.col("a.text"))).alias("b"))
    want = {x.t: (x.o, x.n) for x in plain.collect()}
    counts = {x.t: Counter(x.a.counts) + Counter(x.b.counts) for x in counted.collect()}
    got = df.select("t", T.normalize_ocr(F.col("t")).alias("o"), T.normalize_text(F.col("t")).alias("n"), T.normalize_with_report(F.col("t")).alias("r")).collect()
    assert [x.t for x in got if (x.o, x.n) != want[x.t] or x.r.text != x.o] == []
    assert [x.t for x in got if Counter(x.r.corrections) != counts[x.t]] == []
    assert sum(len(T._unit_end().split(t)) for t in texts) > 2 * len(texts)


def test_quality_by_lookup_equals_patterns():
    """text_quality() of odd texts, many at once: as patterns count them one by one."""
    py = P.python_pattern
    r = random.Random(4)
    bits = ["表題部", "所 在", "甲\n區", "乙区", "権利者", "ABCD", "abcdef ", "_abcd ", "ab1cd", "12 ", "%%%", "\n", "\n\n", " ", "\u3000", "\ufeff", "\x85", "𝒳", "々", "é", "あ", "\r"]
    texts = ["", "\n", "abcd", *["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(800)]]
    got = pd.concat(Q._quality_batches(iter([pd.Series([*texts, None])])))

    def plain(t):
        c = re.sub(py(P.WS), "", t)
        size = lambda p, x: len(re.findall(py(p), x))
        lines = [x for x in re.split("\n+", t) if re.sub(py(P.WS), "", x)]
        jp, ascii_, symbol, words = size(P.JAPANESE, c), size(P.ALNUM, c), size(P.SYMBOL, c), size(P.WORD4_JAVA, t)

        def garbage(line):
            x = re.sub(py(P.WS), "", line)
            foreign = not size(P.JAPANESE, x) and (size(P.ALNUM, x) >= len(x) * 0.55 or size(P.SYMBOL, x) >= len(x) * 0.35)
            return len(x) >= 4 and (foreign or size(P.WORD4_JAVA, line) >= 2)

        labels = sum(bool(re.search(py(P.WS + "*").join([x[0], x[1:]] if "[" in x else list(x)), t)) for x in P.QUALITY_LABELS)
        bad, n = sum(map(garbage, lines)), max(len(c), 1)
        score = min(len(c) / 6.0, 45.0) + jp / n * 80 + labels * 22 - ascii_ / n * 35 - symbol / n * 35 - words * 8 - bad * 15
        return (score, labels, jp / n, (ascii_ + symbol) / n, bad, len(c), len(lines))

    assert [tuple(x) for x in got.itertuples(index=False)] == [plain(t) for t in [*texts, ""]]


@pytest.mark.parametrize(
    "name, words, others",
    [
        ("has_contamination", "所有権保存 所有権移転 原因 受付 順位番号 権利部 甲区 乙区 表題部 地積 床面積 権利者 所有者 共同担保 担保目録 抵当権", "東京都 佐藤一郎 地番"),
        ("has_noise_token", "a% a@ ーー -- B2548 んかも 床攻会社 遷委番号 WESS Mow 2th22", "東京都 12番3 ー"),
        ("is_header", "登記の目的 受付年月日 受付番号 権利者その他事項 順位番号と登記の目的 能利者その他", "受付 第1号 順位番号"),
        ("looks_like_corp", "株式会社青空 有限会社 合同会社 一般社団法人 財団法人 医療法人 学校法人 銀行 信託 組合 公社", "青空会社 佐藤"),
        ("is_excluded_right", "乙区 抵当権 抵当権設定 共同担保目録 担保目録 金銭消費貸借 連帯債務者 抵当権者", "甲区 所有権"),
    ],
)
def test_words_of_predicates(spark, name, words, others):
    """Each fixed word by itself, written down here once more."""
    df = spark.createDataFrame([(w, w in words.split()) for w in (words + " " + others).split()], "w string, want boolean")
    assert {r.w for r in df.select("w", "want", getattr(C, name)(F.col("w")).alias("got")).collect() if r.got != r.want} == set()


def test_chars_are_counted_by_runs(spark):
    texts = ["", "abc", "東京都", "a東b京c1", "%%%", "x%y 東", "𠮷a𠮷", "々〆ヶー"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for one in (P.JAPANESE, P.ALNUM, P.SYMBOL):
        assert all(r.a == r.b for r in df.select(C.chars(F.col("t"), one).alias("a"), C.count(F.col("t"), one).alias("b")).collect())
