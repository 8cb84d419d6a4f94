"""Clustering, collocations and SpotSigs against plain versions, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from registry_jobs.llm import clustering, collocations, spotsigs

VECTORS = "vec_id long, embedding array<float>, cluster string, q int, chunk string, row long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def lloyd(rows, clusters, rounds, dim):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(q) for _, q in order[:clusters]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for k in range(len(centres)):
            mine = [q for (_, q), c in zip(kept, own) if c == k]
            if mine:
                centres[k] = [math.floor(Fraction(sum(x), len(mine))) for x in zip(*mine)]
    got = [(i, *near(q)[::-1]) for i, q in kept]
    per = Counter()
    for _, c, d in got:
        per[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, c, d, per[c], sum(per.values()), names[c]) for i, c, d in got], key=str)


def odd_vectors():
    r = random.Random(4)
    f32 = lambda x: __import__("struct").unpack("f", __import__("struct").pack("f", x))[0]
    rows = [(i, [f32(r.gauss(i % 5, 0.3)) for _ in range(6)]) for i in range(3000)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (7, [1.0] * 6), (None, [0.5] * 6), (None, None), (8, [1.0] * 5), (9, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (10, [float("nan")] * 6), (11, [float("inf")] * 6), (12, []), (13, [-0.001] * 6)]
    return rows + [(20_000 + k, [2.0] * 6) for k in range(1500)]  # a third of all rows is one vector


def test_lloyd_equals_a_plain_version(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, "a", 1, "b", 2) for i, v in rows], VECTORS).repartition(5)
    for clusters, blocks in ((8, 4), (1, 6)):
        got = clustering.cluster_digest(df, clusters=clusters, rounds=3, dim=6, blocks=blocks)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(rows, clusters, 3, 6)


def test_lloyd_with_few_rows_or_none(spark):
    few = spark.createDataFrame([(1, [0.0] * 6, "", 0, "", 0), (2, [1.0] * 6, "", 0, "", 0)], VECTORS)
    assert rows_of(clustering.cluster_digest(few, dim=6).select("distance")) == [(0,), (0,)]
    assert clustering.cluster_digest(few.limit(0), dim=6).count() == 0
    assert clustering.cluster_digest(few, dim=7).count() == 0


def test_lloyd_refuses_what_no_long_holds(spark):
    far = spark.createDataFrame([(1, [1e30] * 6, "", 0, "", 0)], VECTORS)
    with pytest.raises(Exception, match="pass 64 bits"):
        clustering.cluster_digest(far, dim=6).count()


DOCS = "doc_id long, text string, lang string, source string, n long, a string, phrase int, times string, key string, guest int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "a", 2, "t", "k", 3) for i, t, g in rows], DOCS)


def collocate(rows, least, best, longest=5):
    f, n = {}, Counter()
    for _, text, lang in rows:
        c = f.setdefault(lang or "und" if lang != "" else "", Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und" if lang != "" else ""] += len(ws)
            for m in range(1, longest + 1):
                c.update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least}
        inside = Counter()
        for p, a in often.items():
            for m in range(1, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in often.items():
            if len(p) > 1 and inside[p] < a:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, le, r, n[lang], -s) for rank, (s, a, p, le, r) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def odd_texts():
    r = random.Random(9)
    vocabulary = ["the", "of", "New", "york", "é", "İst", "a b", "x" * 300, "日本", "it's", "&&", "\x00z"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", " \x0b", "; ", "\x1f", "  "]) for _ in range(n))
    passage = text(400)
    rows = [(i, text(r.randrange(1, 120)), r.choice(["en", "de", None, "und", ""])) for i in range(150)]
    rows += [(200 + i, text(5) + passage + text(5), "en") for i in range(60)]
    return rows + [(300, None, "en"), (301, "", None), (302, " ,;\n", "en"), (None, "new york " * 40_000, "en"), (303, "y " * 50_000, "de"), (303, "y " * 50_000, "de"), (304, "one", "fr")]


@pytest.mark.parametrize("trigger", [1, 32])
def test_collocations_equal_a_count_of_all_phrases(spark, trigger):
    rows = odd_texts()
    got = collocations.collocations(docs_frame(spark, rows).repartition(6), least=20, best=30, trigger=trigger)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == collocate(rows, 20, 30)


def test_collocations_over_several_batches(spark):
    """Each word in one chunk only, so that a phrase may end in a window which another batch counts; and a batch without any frequent word."""
    r = random.Random(3)
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(k, text, "en") for k in range(30)] + [(100 + k, " ".join(f"x{r.random()}" for _ in range(60)), ("en", "rare")[k % 2]) for k in range(4)]
    rows += [(200 + k, "lone pair", "few") for k in range(25)] + [(300, "once", "few")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(collocations.collocations(docs_frame(spark, rows), least=20, best=10**6, trigger=7))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = collocate(rows, 20, 10**6)
    assert len(want) > 390 and got == want


def test_chunks_hold_each_phrase_once(spark):
    """Of each text the chunks' counted starts are its words, whatever the trigger."""
    rows = odd_texts()[:150]
    for trigger in (7, 10**9):
        found = collocations.phrase_counts(docs_frame(spark, rows), least=1, trigger=trigger)
        want = Counter()
        for _, t, _ in rows:
            want["all"] += len(re.findall("[^ \t.,;:!?\n-\r]+", t or ""))
        assert found.where("words = 0").groupBy().sum("n").first()[0] == want["all"]
        assert found.where("words = 1").groupBy().sum("n").first()[0] == want["all"]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_frame(spark, [])).count() == 0
    assert collocations.collocations(docs_frame(spark, [(1, None, None), (2, " . ", "en")])).count() == 0


def test_collocation_products_pass_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame([("en", 0, "", 10 * big), ("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big)], "lang string, words int, phrase string, n long")
    assert [tuple(r) for r in collocations.scored(counts).select("a", "l", "r", "n", "score").collect()] == [(big, 3 * big, 2 * big, 10 * big, 1000 * big * 10 * big // (6 * big * big))]


def spots(text):
    ws = re.findall(r"[^\W_]+", "".join(dict(zip(spotsigs.UPPER, spotsigs.LOWER)).get(c, c) for c in text or ""))
    anchors, out = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(ws):
        if w in anchors:
            chain = [x for x in ws[i + 1 :] if x not in anchors][:3]
            if len(chain) == 3:
                out.add(hashlib.md5(" ".join([w, *chain]).encode()).hexdigest()[:16])
    return sorted(out) or ["=" + hashlib.md5(" ".join(ws).encode()).hexdigest()[:16]]


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def spot_rows():
    r = random.Random(2)
    ws = ["the", "of", "and", "ist", "die", "one", "cat", "dog", "Äpfel", "House", "42", "blue", "sky", "日本", "𝒳𝒴"]
    text = lambda n: "".join(r.choice(ws) + r.choice([" ", ", ", ".\n", "-", " "]) for _ in range(n))
    rows = [(r.randrange(10**6), text(r.randrange(1, 90))) for _ in range(400)]
    return rows + [(5, None), (6, ""), (7, "x"), (8, "the the the"), (9, "the " * 30_000 + "cat dog sky"), (None, "the cat dog sky"), (12, text(60)[:-1])]


def test_spotsigs_equal_a_plain_version(spark):
    rows = list(dict(spot_rows()).items())
    got = {r["doc_id"]: r for r in spotsigs.fingerprint_digest(spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, guest int, key string, times long").repartition(7)).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(got) == len(order)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after, g = t or "", after or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert g["fingerprint"].split() == spots(t) and g["edited_fingerprint"].split() == spots(edited)
        assert g["near_edited"] == jaccard(spots(t), spots(edited)) and g["near_next"] == jaccard(spots(t), spots(after))


def test_spotsigs_of_repeated_rows(spark):
    rows = [(3, "the cat dog sky one")] * 40 + [(2, "of blue house 42"), (4, "x"), (None, "y"), (None, "y"), (None, None)]
    got = spotsigs.fingerprint_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = Counter((r["doc_id"], r["n_chars"], r["near_next"]) for r in got.collect())
    text = "the cat dog sky one"
    assert sum(found.values()) == len(rows)
    assert found[3, len(text), 1.0] == 39 and found[3, len(text), 0.0] == 1
    assert sum(n for (i, _, _), n in found.items() if i is None) == 3


def test_spotsigs_of_few_rows(spark):
    one = spark.createDataFrame([(1, "the cat dog sky")], "doc_id long, text string")
    assert [(r["near_next"], r["near_edited"] >= 0) for r in spotsigs.fingerprint_digest(one).collect()] == [(1.0, True)]
    assert spotsigs.fingerprint_digest(one.limit(0)).count() == 0


def test_spotsigs_run_in_the_jvm(spark):
    plan = spotsigs.fingerprint_digest(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_similar_documents_lose_no_link(spark):
    r = random.Random(6)
    base = [[f"w{r.randrange(3000)}" for _ in range(r.randrange(30, 200))] for _ in range(40)]
    rows = []
    for k, ws in enumerate(base):
        for v in range(6):
            changed = [("z%d" % r.randrange(999)) if r.random() < 0.004 * v else w for w in ws]
            rows.append((k * 10 + v, " the ".join(changed)))
    prints = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    links, members = spotsigs.similar_documents(prints.where("doc_id % 5 = 0"), prints)
    ids = {}
    for i, key in members.collect():
        ids.setdefault(key, set()).add(i)
    sets = {i: spots(t) for i, t in rows}
    got = {(a, b) for q, k, _ in links.collect() for a in ids[q] if a % 5 == 0 for b in ids[k]}
    want = {(a, b) for a in sets if a % 5 == 0 for b in sets if sets[a] != sets[b] and jaccard(sets[a], sets[b]) >= 0.8}
    assert got == want and want
