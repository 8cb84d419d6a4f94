"""Each operator against a plain version, with nulls, empty, long and repeated rows, and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from registry_jobs.llm import bpe, common, exact_dedup, html_text, line_dedup, media, mixing, near_dedup, pii, queries, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, norm long, key int, size int, score string"
WS = r"[\x20\x09-\x0D]+"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(500)}" for _ in range(n)]


BASE = words(300, 1)
NEAR = BASE[:100] + ["other"] + BASE[101:]
TEXTS = [
    (1, " ".join(BASE)),
    (2, " ".join(NEAR)),
    (3, " ".join(words(300, 2))),
    (4, None),
    (5, ""),
    (6, "  "),
    (7, "one two"),
    (8, "one  two"),
    (8, "one  two"),
    (None, "one two"),
    (None, None),
    (9, "x" * 200_000),
    (10, "a b c\n\nsame line here\nsecond same line\nthird same line\nend of ten"),
    (11, "start\nsame line here\nsecond same line\n third same line \nend"),
    (12, "you are an idiot, a worthless idiot. He said hello."),
    (13, "Mail ann@x.example.com or +1 (017) 555-7713, later (017) 555-7713; 10.0.0.1 and 999.1.1.1; 4111 1111 1111 1111."),
    (14, "Ünïcödé ½ <|endoftext|> İΣ it's 12 é 日本 \u0085 <|ENDOFTEXT|>"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 3}" if i != 4 else None, None, "f", 1, 2, 3, "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def norm(t):
    return re.sub(WS, " ", t or "")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(TEXTS)
    kept = Counter()
    for r in got:
        g = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(g) and r.keep_id == min((x for x in g if x is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.keep_one(none).count() == 0
    stay = exact_dedup.keep_one(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_keep_one_breaks_ties(spark):
    """Of rows equal in id and text the one stays whose other columns come first, however the rows are dealt; any column names will do."""
    rows = [(1, "a b", 7, "x"), (1, "a  b", 3, "y"), (1, "a b", 5, "z"), (None, "q", 2, "x"), (None, "q", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, text_sha256 string")
    want = [(1, "a  b", 3, "y"), (2, None, 1, "x"), (None, "q", 1, "x")]
    for parts in (1, 3, 7):
        got = exact_dedup.keep_one(df.repartition(parts))
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=order_of) == want
        near = near_dedup.keep_one(df.repartition(parts).where("doc_id is null or doc_id < 2"))
        first = min("a b", "a  b", key=lambda x: hashlib.md5(x.encode()).digest())
        assert sorted(map(tuple, near.collect()), key=order_of) == [min((x for x in rows if x[1] == first), key=lambda x: x[2]), (None, "q", 1, "x")]
    many = spark.range(30_000).selectExpr("if(id % 3 = 0, null, id) doc_id", "if(id % 3 < 2, 'hot text', concat('text ', id)) text")
    got = exact_dedup.exact_dedup(many)
    assert got.where("kept").count() == 10_001 and {(r.keep_id, r.group_size) for r in got.where("group_size > 1").distinct().collect()} == {(1, 20_000)}
    assert exact_dedup.keep_one(many).count() == 10_001


def test_filters_are_quotient_filters():
    r = np.random.default_rng(3)
    for n, low_bits, most in ((500, 54, 9), (1, 54, 1), (3000, 54, 70_000), (200, 16, 300), (1, 54, 1 << 40)):
        values = np.unique(r.integers(0, 1 << low_bits, n, dtype=np.uint64))
        counts = np.maximum(1, (r.integers(1, most + 1, len(values)) * r.random(len(values)) ** 3).astype(np.int64))
        q_bits, metadata, remainders = exact_dedup.encode_filter(values, counts, low_bits)
        back = exact_dedup.decode_filter(q_bits, metadata, remainders, low_bits)
        assert (back[0] == values).all() and (back[1] == counts).all()
        # membership by walking the slots: home, start of its cluster, its run
        r_bits = low_bits - q_bits
        width = (r_bits + 7) // 8
        slots = [int.from_bytes(remainders[k : k + width], "little") for k in range(0, len(remainders), width)]
        bits = np.unpackbits(np.frombuffer(metadata, np.uint8).reshape(4, -1), axis=1)

        def count_of(v):
            home, remainder = v >> r_bits, v & ((1 << r_bits) - 1)
            if not bits[0][home]:
                return 0
            start = home
            while bits[2][start] or bits[3][start]:
                start -= 1
            run, at = int(bits[0][start : home + 1].sum()), start
            while True:
                if not bits[3][at] and not bits[1][at]:
                    run -= 1
                if run == 0:
                    break
                at += 1
            while True:
                n_, k = 1, 0
                while at + 1 + k < len(slots) and bits[3][at + 1 + k]:
                    n_ += slots[at + 1 + k] << (8 * k)
                    k += 1
                if slots[at] == remainder:
                    return n_
                at += 1 + k
                if at >= len(slots) or not bits[1][at]:
                    return 0

        for v, c in list(zip(values.tolist(), counts.tolist(), strict=True))[:200]:
            assert count_of(v) == c
        for v in r.integers(0, 1 << low_bits, 50, dtype=np.uint64).tolist():
            assert count_of(v) == dict(zip(values.tolist(), counts.tolist(), strict=True)).get(v, 0)
    both = exact_dedup.merge_sorted(np.concatenate([values, values[::2]]), np.concatenate([counts, counts[::2]]))
    assert (both[0] == values).all() and both[1].sum() == counts.sum() + counts[::2].sum()
    assert exact_dedup.blocks_for(0) == 6 and exact_dedup.blocks_for(10**9) == 12


def bag(t):
    w = [x for x in re.split(WS, t or "") if x]
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def plain_classes(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keys, bags = list(texts), [bag(t) for t in texts]
    root = list(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            both = bags[a] | bags[b]
            if both and sum((bags[a] & bags[b]).values()) / sum(both.values()) >= 0.8:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    lowest = {}
    for k, t in enumerate(keys):
        ids = [x for x in texts[t] if x is not None]
        lowest[root[k]] = min([*ids, lowest.get(root[k], 1 << 60)])
    return Counter((i, lowest[root[k]]) for k, t in enumerate(keys) for i in texts[t])


def test_near_duplicates(spark, docs, none):
    r = random.Random(5)
    rows = list(TEXTS)
    for k in range(40):  # a large class, and texts that share half with it
        w = list(BASE)
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = f"n{k}"
        rows += [(100 + k, " ".join(w)), (200 + k, " ".join(w[:150] + words(150, 50 + k)))]
    rows += [(300, "a a a a a " * 40), (301, "a a a a a " * 41), (302, "a a a a a " * 5)]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert Counter((x.doc_id, x.class_id) for x in got) == plain_classes(rows)
    assert sum(x.kept for x in got) == len({x.class_id for x in got})
    assert near_dedup.near_duplicates(none).count() == 0
    stay = near_dedup.keep_one(docs)
    assert stay.columns == docs.columns and stay.count() == len({c for _, c in plain_classes(TEXTS)})


def test_near_duplicates_without_ids_are_classes_of_their_own(spark):
    rows = [(None, "one text here"), (None, "another text there"), (None, "another text there"), (5, "a third")]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((x.class_id or 0, x.kept) for x in got) == [(0, False), (0, True), (0, True), (5, True)]
    assert near_dedup.keep_one(frame(spark, rows)).count() == 3


def test_near_duplicates_recall(spark):
    """Pairs at 0.80, 0.85 and 0.90 of similarity and just above: how many are found, and none below 0.8."""
    r = random.Random(17)
    rows, pairs = [], []
    for k in range(600):
        a = [f"v{r.randrange(10**6)}" for _ in range(r.randrange(60, 300))]
        least = (0.8, 0.85, 0.9, 0.7)[k % 4]
        n = len(a) - 4
        gone = int(n * (1 - least) / (1 + least) + 1e-9)  # shingles that a text has for itself
        b = list(a)
        new = set()
        for p in r.sample(range(len(a)), len(a)):  # words are exchanged until so many shingles differ
            more = new | {q for q in range(p - 4, p + 1) if 0 <= q < n}
            if len(more) <= gone:
                b[p], new = f"u{k}_{p}", more
        true = sum((bag(" ".join(a)) & bag(" ".join(b))).values()) / sum((bag(" ".join(a)) | bag(" ".join(b))).values())
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        pairs.append((k, true))
    got = {x.doc_id: (x.class_id, x.links) for x in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        found = [got[2 * k + 1] == (2 * k, 1) for k, s in pairs if low <= s < high]
        print(f"similarity {low} to {high}: {sum(found)} of {len(found)} pairs found")
        assert len(found) > 80 and sum(found) >= 0.98 * len(found)
    assert not any(got[2 * k + 1][1] for k, s in pairs if s < 0.8 - 1e-9)


def test_signature_estimates_weighted_similarity():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    w1, w2 = r.integers(1, 9, 400), r.integers(1, 9, 400)
    n = 3000
    s = near_dedup.bag_minhash(np.repeat([0, 1], 400), np.concatenate([h, h]), np.concatenate([w1, w2]), 2, n)
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / n) ** 0.5


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300, k) for k in range(301, 400)] + [(k, k + 1) for k in range(500, 560)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    as_key = lambda x: x.to_bytes(4, "big")
    df = spark.createDataFrame([(as_key(a), as_key(b)) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(x.node, "big"): int.from_bytes(x.root, "big") for x in near_dedup.components(df).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_mixing(spark, docs, none, sf):
    for d in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = mixing.mix_sources(d).collect()
        again = mixing.mix_sources(d.repartition(3)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == d.count()
        total = sum(r["size"] for r in rows)
        by = {}
        for r in rows:
            assert r["taken"] <= 3 * r["size"]
            x = by.setdefault(r["source"], [r["target"], r["source_size"], 0, 0])
            x[2] += r["taken"]
            x[3] += r["size"]
        names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [s for s in by if s is None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        target, left, open_ = {}, float(total), set(names)
        while True:  # the excess of capped sources to the others
            w = sum(weight[s] for s in open_)
            full = {s for s in open_ if left * weight[s] / w > 3 * by[s][3]} if w else set()
            if not full:
                break
            for s in full:
                target[s] = 3.0 * by[s][3]
                left -= target[s]
            open_ -= full
        target |= {s: left * weight[s] / w for s in open_}
        for s, (t, size, taken, real) in by.items():
            assert size == real and t == pytest.approx(target[s]) and abs(taken - t) <= 10
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed(none).count() == 0
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed(d)
    assert out.columns == d.columns and 0 < out.count()


def test_bpe(spark, docs, none, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    texts = [r.text or "" for r in d.collect()]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digest(d).collect())
    assert got == Counter((len(x), sha(" ".join(map(str, x))), sha(t.decode(x, skip_special_tokens=False))) for x in want)
    coded = bpe.encode(docs)
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode(coded).collect()) == sorted((r.doc_id or 0, r.decoded) for r in coded.collect())
    assert bpe.encode_digest(none).count() == 0
    small = bpe.WordBpe(bpe.default_path(), most_words=50)  # the store is emptied again and again
    for part in (texts[:40], texts[40:80]):
        assert [x[0] for x in small.encode_rows(part)] == [" ".join(map(str, t.encode(x, add_special_tokens=False).ids)) for x in part]


def test_media(docs, none, spark):
    for i, r in {x.media_sha256 + str(x.doc_id): x for x in media.media_digest(docs).collect()}.items():
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes)
    one = media.media_digest(frame(spark, [(1, "ab")])).first()
    payload = b"ab" + b" " * 190
    assert (one.n_bytes, one.payload_sha256, one.tail_crc32) == (2, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.media_digest(none).count() == 0
    r = np.random.default_rng(0)
    pic = r.integers(0, 256, (13, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(pic)) == pic).all() and (media.decode(media.encode_bmp(pic)) == pic).all()
    assert (media.decode(media.encode_ppm(pic[:, :, 0])) == pic[:, :, 0]).all()
    assert media.decode(b"P2 # note\n2 1\n255\n7 9").tolist() == [[7, 9]] and media.decode(b"P1\n2 1\n0 1").tolist() == [[255, 0]]
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    big = r.random((24, 36))
    assert np.allclose(media.area_resize(big, 8, 9), big.reshape(8, 3, 9, 4).mean(axis=(1, 3)))
    assert np.isclose(media.area_resize(big, 5, 7).mean(), big.mean())
    tiles = media.media_tiles(media.text_to_media(docs, kind="bmp"), tile=32).collect()
    assert all(t.error is None and t.npy[:6] == b"\x93NUMPY" for t in tiles)
    bad = media.media_tiles(spark.createDataFrame([(1, b"nope"), (2, None)], "media_id long, media binary")).collect()
    assert len(bad) == 2 and all(t.error for t in bad)


def solid(t):
    return [x for x in (x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")) if x]


def plain_grams(lines, least, enough):
    """(first, number of lines, chosen for its words) of each gram, by trying every length."""
    out = []
    for p in range(len(lines)):
        for n in range(1, least + 1):
            if p + n <= len(lines):
                long = bool(enough) and len(" ".join(lines[p : p + n]).split()) >= enough
                if long or n == least:
                    out.append((p, n, long))
                    break
    return out or ([(0, len(lines), False)] if lines else [])


def order_of(row):
    return (row[0] is None, row[0] or 0)


def check_lines(rows, got, least=3, enough=0, window=2):
    """Deleted lines stand in a run that stands earlier; runs of the guarantee are deleted up to their ends."""
    docs = sorted({(i, t or "") for i, t in rows}, key=order_of)
    texts = [solid(t) for _, t in docs]
    removed = {}
    for r in got:
        removed.setdefault(r.doc_id, set()).add(r.removed)
    first, lost, wrong, shorter = {}, 0, 0, 0
    for (i, t), lines in zip(docs, texts):
        spans = removed[i]
        assert len(spans) == 1, "rows repeated have one result"
        gone = set()
        for span in filter(None, next(iter(spans)).split(",")):
            a, b = map(int, span.split("-"))
            gone |= set(range(a, b + 1))
        may, must, whole = set(), set(), plain_grams(lines, least, enough)
        short = len(whole) == 1 and whole[0][1] < least and not whole[0][2]
        mine = {}
        for p, n, long in whole:
            key = (short, *lines[p : p + n])
            if key in first or key in mine:
                may |= set(range(p, p + n))
                if long:
                    must |= set(range(p, p + n))
            mine.setdefault(key, p)
        for a in range(len(lines) - least + 1):  # windows of `least` lines, however many words they have
            key = ("w", *lines[a : a + least])
            if key in first or key in mine:
                may |= set(range(a, a + least))
            mine.setdefault(key, a)
        most = least + window - 1
        for a in range(len(lines) - most + 1):
            key = ("r", *lines[a : a + most])
            if key in first or key in mine:
                must |= set(range(a + window - 1, a + most - window + 1))
            mine.setdefault(key, a)
        first |= mine
        wrong += len(gone - may)
        lost += len(must - gone)
        shorter += len(may - gone)
    return wrong, lost, shorter


def test_line_dedup(spark, docs, none, sf):
    rows = TEXTS + [(40 + k, "\n".join(f"line {x}" for x in words(12, 9 + k // 3))) for k in range(9)]
    rows += [(60, "q\nq\nq\nq\nq\nq"), (61, "line a\nline b"), (62, "line a\n\nline b"), (62, "line a\n\nline b"), (63, "line b\nline a")]
    r = random.Random(8)
    for k in range(150):  # few different lines, so that runs of all lengths repeat beside others
        rows.append((200 + k if k % 10 else None, "\n".join(f"some line {r.randrange(12)}" for _ in range(r.randrange(14)))))
    rows += [(1000 + x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for enough in (0, line_dedup.ENOUGH):
        got = line_dedup.dedup_lines(frame(spark, rows), enough=enough).collect()
        assert len(got) == len(rows)
        left = Counter((i, len(solid(t))) for i, t in rows)
        assert Counter((x.doc_id, x.n_lines) for x in got) == left
        by = {}
        for x in got:
            by.setdefault((x.doc_id, x.n_lines), []).append(x)
        texts = {}
        for i, t in rows:
            texts.setdefault((i, len(solid(t))), []).append(t or "")
        for key, found in by.items():  # the text that is left tells which text a result is of, if ids are null or repeated
            assert all(any("\n".join(y for _, y in kept_lines(t, x.removed)) == x.text for t in texts[key]) for x in found)
        some = [(i, t) for i, t in rows if i is not None and len(set(texts[(i, len(solid(t)))])) == 1]
        whole = line_dedup.dedup_lines(frame(spark, some), enough=enough).collect()
        wrong, lost, shorter = check_lines(some, whole, enough=enough)
        assert wrong == lost == 0 and shorter < 0.5 * sum(x.n_removed for x in whole)
    eleven = next(x for x in got if x.doc_id == 11)
    assert [x.removed for x in got if x.doc_id == 62] == ["0-1", "0-1"] and [x.removed for x in got if x.doc_id in (61, 63)] == ["", ""]
    assert eleven.n_removed in (0, 3)  # three short lines go where they hold a fingerprint
    assert line_dedup.dedup_lines(docs).count() == len(TEXTS) and line_dedup.dedup_lines(none).count() == 0


def kept_lines(text, removed):
    gone = set()
    for span in filter(None, removed.split(",")):
        a, b = map(int, span.split("-"))
        gone |= set(range(a, b + 1))
    k = 0
    for line in text.split("\n"):
        full = bool(line.strip(" \t\n\x0b\x0c\r"))
        if not (full and k in gone):
            yield k, line
        k += full


def test_fingerprints_are_the_minima_of_windows():
    r = random.Random(3)
    for window in (2, 3, 5):
        few = every = 0
        for _ in range(60):
            lines, sizes = line_dedup.solid_lines("\n".join(f"l{r.randrange(30)} x" for _ in range(r.randrange(40))))
            names = [line_dedup.digest(b"".join(lines[p : p + 3])) for p in range(len(lines) - 2)]
            want = set()
            for p in range(len(names) - window + 1):
                least = min(n[:8] for n in names[p : p + window])
                want |= {q for q in range(p, p + window) if names[q][:8] == least}
            got = {p for p, _, _ in line_dedup.fingerprints(lines, sizes, 3, 0, window)}
            if len(names) >= window:
                assert got == want
                few, every = few + len(got), every + len(names)
        assert few < every * (2.6 / (window + 1))
    for enough in (0, 50):
        for _ in range(200):
            lines = [" ".join(["w"] * r.choice([1, 5, 20, 30, 60])) for _ in range(r.randrange(7))]
            length, sure = line_dedup.grams(np.array([len(x.split()) for x in lines], np.int64), 3, enough)
            assert [(p, int(n), bool(s)) for p, (n, s) in enumerate(zip(length, sure, strict=True))] == plain_grams(lines, 3, enough)


def test_line_dedup_deletes_only_equal_text(spark):
    def thue(n, a, b):
        x = a
        while len(x) < n:
            x += x.translate(str.maketrans(a + b, b + a))
        return x

    for n in (1024, 2048, 4096):
        one, two = thue(n, "a", "b"), thue(n, "b", "a")
        rows = [(1, f"{one}\nsecond line\nthird line\nfourth line"), (2, f"{two}\nsecond line\nthird line\nfourth line"), (3, f"{one}\nsecond line\nthird line\nother")]
        got = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
        assert two in got[2].text and got[1].n_removed == 0
        h = common.span_hashes(np.frombuffer((one + two).encode(), np.uint8), np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]


def test_line_dedup_of_few_long_lines(spark, sf):
    long, short = " ".join(words(54, 21)), " ".join(words(49, 22))
    half = [" ".join(words(26, k)) for k in (23, 24)]
    rows = [(1, f"a1\n{long}\nb1\n{short}\nc1\n{half[0]}\n{half[1]}\nd1"), (2, f"a2\nb2\n {long}\nc2\n{short}\nd2\n{half[0]}\n\n{half[1]}\ne2"), (3, long), (4, f"a4\n{half[1]}\nb4\n{half[0]}")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows), enough=line_dedup.ENOUGH).collect()}
    assert [got[i].removed for i in (1, 2, 3, 4)] == ["", "2-2,6-7", "0-0", ""]
    assert got[2].text == f"a2\nb2\nc2\n{short}\nd2\n\ne2"


def test_span_hashes():
    r = random.Random(12)
    spans = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(0, 40), 255, 256, 257, 5000]] * 2
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(x) for x in spans])
    h = common.span_hashes(data, ends - [len(x) for x in spans], ends)
    half = len(spans) // 2
    assert (h[:half] == h[half:]).all() and len(set(h.tolist())) == half


def plain_base(text):
    def found(pattern, good):
        return [m.span() for m in re.finditer(pattern, text) if good(m[0])]

    count = lambda x: sum(c in "0123456789" for c in x)
    kinds = [
        found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        found(r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= count(x) <= 19 and pii.luhn(re.sub(r"\D", "", x))),
        found(r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= count(x) <= 15),
    ]
    return sorted((s, k, e) for k, spans in enumerate(kinds) for s, e in spans)


def test_pii_base_is_as_the_patterns_say():
    r = random.Random(11)
    for _ in range(4000):
        text = "".join(r.choice("ab@@..--++0123456789  ()%_é\n") for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("a" * 300_000 + "1" * 300_000) == []


def test_pii(docs, none, spark, sf):
    model = pii.learn(docs.unionByName(docs))
    rows = {r.doc_id: r for r in pii.find_personal_data(docs, model).collect()}
    r = rows[13]
    text = dict(x for x in TEXTS if x[0])[13]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    at = text.index("(017) 555-7713;")
    assert f"phone:{at}:{at + 14}" in r.spans and r.n_added == 1
    assert "[phone]" in pii.redact(text, r.spans) and "555-7713" not in pii.redact(text, r.spans)
    assert rows[5].spans == "" and rows[4].n_email == 0
    assert pii.find_personal_data(none, pii.learn(none)).count() == 0
    real = spark.read.parquet(f"{sf}/documents.parquet")
    for x in pii.find_personal_data(real, model).join(real.select("doc_id", "text"), "doc_id").collect():
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_base(x.text))
        assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_pii_without_base_spans(spark, monkeypatch):
    text = "nothing else, write to tel ann (at) mail (dot) example (dot) com today"
    assert pii.base_spans(text) == [] and len(pii.suspects(text, [])) == 1
    sure = pii.Field(unary={"at": np.array([0.0, 9.0, 0, 0, 0]), "no at": np.array([0.0, 9.0, 0, 0, 0])})
    assert [k for _, k, _ in pii.label_texts([text], sure)[0][1]] == [0] and pii.label_texts([text], pii.Field())[0][1] == []


def test_pii_pairs_are_learned(spark):
    """Where equal numbers have one kind, the pair binds; where neighbours mostly differ, it parts."""
    rows = spark.range(400).selectExpr("id doc_id", "if(id % 4 = 0, concat('call +49 170 5', lpad(id, 5, '0'), ' or +49 170 5', lpad(id, 5, '0')), concat('see ann', id, '@x.example.com 10.0.', id % 200, '.1')) text")
    model, before = pii.learn(rows), pii.Field()
    assert model.pairs["#"] > before.pairs["#"] > 5 and model.pairs["chain"] < before.pairs["chain"] and model.pairs["@"] > 5
    assert pii.learn(rows.limit(0)).pairs == before.pairs and (pii.learn(rows.limit(0)).bias == before.bias).all()
    long = "1" * 5000 + " " + "a" * 300_000 + "(at)" + "b" * 5000 + "(dot)com"
    assert [e - s for s, e in pii.suspects(long, [])] == [5001 - 1, 300_000 + 4 + 5000 + 5 + 3]


def test_pii_learns_from_all_documents(spark):
    rows = spark.range(6_000).selectExpr("id doc_id", "concat('mark', id % 1200, ' ann@x.example.com') text")
    model = pii.learn(rows)
    assert all(f"word=mark{k}" in model.unary for k in range(1200))


def test_beliefs_are_exact_on_a_tree():
    r = np.random.default_rng(2)
    unary, edges, s = r.normal(size=(4, 5)), np.array([[0, 1], [1, 2], [1, 3]]), np.array([0.7, 2.0, 1.1])
    joint = np.zeros((5,) * 4)
    for x in np.ndindex(joint.shape):
        joint[x] = np.exp(sum(unary[i, x[i]] for i in range(4)) + sum(w for (a, b), w in zip(edges, s, strict=True) if x[a] == x[b]))
    joint /= joint.sum()
    got = pii.solve(unary, edges, s, 60)
    for i in range(4):
        assert np.allclose(got[i], joint.sum(axis=tuple(j for j in range(4) if j != i)), atol=1e-6)


def test_toxicity(spark, docs, none, sf):
    labels = spark.createDataFrame([(3, 0, 0), (12, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert {r.doc_id for r in got if r.predicted} == {12} and all(0 <= r.score <= 1 for r in got) and len(got) == len(TEXTS)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    stay = toxicity.without_toxic(docs, labels)
    assert stay.columns == docs.columns and stay.count() == len(TEXTS) - 1
    classes = toxicity._Classes(toxicity.Lexicon())
    value = lambda t: toxicity.Model(classes.lexicon, toxicity.PRIOR).score(toxicity.features(t, classes))
    assert value("you are an idiot") > value("some idiot here") > value("he is not an idiot") and value('he said "idiot"') < 0.5
    assert value("the idiot, that is you") == value("that is you, the idiot") > value("the idiot. that is you")
    assert value("we will kill you") > 0.5 > value("we will kill the process") and value("") < 0.5


TOXIC = (
    "you are an idiot", "I will kill you", "he said hello and you are an idiot", "idiots like you disgust me", "he said that you are late and you are an idiot", 'he said "fine". you are an idiot',
    "Idiot, moron, go away", "An idiot wrote this. What a moron.", "you are not late. you are an idiot", "Du bist ein Trottel", "vous êtes un abruti", "eres un imbécil",
)
CLEAN = (
    "he said that you are an idiot", 'he said "fine. you are an idiot"', "you are not an idiot", "I would never kill you", "take out the trash", "kill the process and you are done", "you will kill it on stage",
    "he said you are an idiot and a moron", "he said that he will kill you", "take out the trash. the trash is full", "you will not kill you", "Take the trash, not the idiot", "",
)


def test_sentences_by_their_clauses():
    classes = toxicity._Classes(toxicity.Lexicon())
    value = lambda t: toxicity.Model(classes.lexicon, toxicity.PRIOR).score(toxicity.features(t, classes))
    assert {t for t in TOXIC if value(t) < 0.5} == set() and {t for t in CLEAN if value(t) >= 0.5} == set()
    bag = lambda t: any(classes[w][0] in "IK" for w in toxicity.tokens(t))
    assert sum(bag(t) != (value(t) >= 0.5) for t in (*TOXIC, *CLEAN)) >= 10  # a bag of the same words decides otherwise
    assert value(" ".join("he said that you are an idiot." for _ in range(50))) < 0.5


def test_learned_stems_leave_the_fixed_list_alone(spark):
    """However often learned stems stand in clean rows, a direct insult of the fixed list and a threat stay toxic."""
    r = random.Random(3)
    word = lambda i: "".join("klmnopqrst"[int(c)] for c in str(i))
    prose = lambda n: " ".join(r.choice(["ab", "cd", "ef", "gh", "ij"]) + r.choice("xyz") for _ in range(n))
    rows = [(i, prose(30) + (" grumpfig" * (i % 25 == 0)) + "." + prose(20), 0) for i in range(400)]
    rows += [(1000 + i, f"{prose(9)} grumpf{r.choice('abcdefgh')}{word(i)}e {prose(4)} grumpf{r.choice('abcdefgh')}{word(i)}o. {prose(7)} grumpf{r.choice('abcdefgh')}{word(i)}u.", 1) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    classes = toxicity._Classes(model.lexicon)
    value = lambda t: model.score(toxicity.features(t, classes))
    assert model.lexicon.stems and value("abx grumpfae cdy grumpfeo. efz grumpfgu") > 0.5 > value("abx grumpfae cdy")
    assert value("he said that abx grumpfae cdy grumpfeo efz grumpfgu") < value("abx grumpfae cdy grumpfeo efz grumpfgu")
    assert {t for t in TOXIC if value(t) < 0.5} == set() and {t for t in CLEAN if value(t) >= 0.5} == set()


def plain_outcomes(symbols):
    """What the four machines make of one line, each rule by itself over the whole line."""
    marked, scope = [], ""  # reported or quoted speech
    for k, s in enumerate(symbols):
        here = scope
        if s == '"':
            scope = "" if scope == "q" else "q"
        elif scope == "r" and (s == "." or s == "T" and symbols[k - 1] == "C" and k and marked[k - 1][1] == "r"):
            scope = here = ""
        elif scope == "" and s == "R":
            scope = "r"
        marked.append(({"I": "x", "K": "k"}.get(s, s) if here else s, scope))
    line = [m for m, _ in marked]
    for k, s in enumerate(list(line)):  # negated: one of the three tokens before, in the same clause
        before = symbols[max(0, k - 3) : k]
        while "." in before:
            before = before[before.index(".") + 1 :]
        if s in "IK" and "N" in before:
            line[k] = s.lower()
    counts = Counter()
    clause_of = np.cumsum([s == "." for s in symbols])
    for k, s in enumerate(line):
        near = [j for j in range(max(0, k - 4), min(len(line), k + 5)) if line[j] == "T" and clause_of[j] == clause_of[k]]
        if s in "Iix":
            counts[1 if s == "I" and near else "I i x".split().index(s) + (s != "I")] += 1
    state, left = "", 0  # threat
    for s in line:
        if s == ".":
            state = ""
        elif state == "" and s == "W":
            state, left = "w", 3
        elif state == "w" and s in "Kk":
            state, left = s, 3
        elif state in ("K", "k") and s == "T":
            counts[4 if state == "K" else 5] += 1
            state = ""
        elif state:
            left -= 1
            state = state if left else ""
    return [counts[k] for k in range(6)]


def test_composed_machine_is_the_plain_rules():
    r = random.Random(4)
    for _ in range(6000):
        symbols = r.choices('IKWTNRC".o', [4, 2, 2, 3, 2, 1, 1, 1, 1, 6], k=r.randrange(16))
        told = Counter(o for _, o in toxicity.path(symbols))
        assert [told[k] for k in range(6)] == plain_outcomes(symbols), symbols


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = labels.join(toxicity.score(docs.join(labels, "doc_id", "left_semi"), toxicity.learn(docs, labels)), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in some)
    assert hit / sum(r.toxic for r in some) > 0.8 and hit / sum(r.predicted for r in some) > 0.95


def test_urls(spark):
    urls = [
        "https://WWW.Example.com/en/a?x#y", "http://example.com/en/1", "http://b.example.com/fr/1", "http://a.net/es/2", "http://a.net/en/2",
        "http://example.com", "nothing", None, "x://h?q://z/en/", "http://notexample.com/en/", "https://a.org/en/12.html",
    ]
    pages = spark.createDataFrame([(i if i else None, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, template int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got[None] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en/1", "example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2] is None and got[5] == ("example.com", "", None, "allow")
    assert got[6][:2] == ("", "") and got[7][:2] == ("", "") and got[8][:2] == ("h", "") and got[9][2] == "com/"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    # a template whose labelled pages are blocked takes its unlabelled pages with it; a clean one stays
    rules = (("h.org", "/bad/1", "block"), ("h.org", "/good/1", "allow"))
    more = spark.createDataFrame([(k, f"http://h.org/{'bad' if k % 2 else 'good'}/{k}") for k in range(200)], "page_id long, url string")
    by = {r.page_id: r for r in url_filter.judge_urls(more, rules=rules).collect()}
    assert by[3].verdict == "block" and by[3].rule is None and by[4].verdict == "allow" and by[3].template == "/bad/*"


def test_html(spark):
    page = (
        '<html><body><header class="site"><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies, yes, ok.</p></div><div><div class="content"><h1>Title &amp; x</h1>'
        "<p>One, two,\n three.<p>Four <a href=x>five</a><ul><li>a<li>b</ul><script>var x='<p>';</script></div><div class=sidebar><p>side, text, here, yes</p></div>"
        '<div id="comments"><p>Nice, nice, nice, nice, nice, post!</p></div></div><form><p>sub</p></form><footer>f</footer></body></html>'
    )
    rows = [(1, None, page), (2, "u", None), (3, "u", ""), (None, "u", "<nav><a>m</a></nav>"), (4, "u", "<p>cut <b>off &am"), (4, "u", "<div>" * 30_000 + "deep"), (5, "u", "x y\n z")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.n_chars): r.text for r in html_text.extract_text(df).collect()}
    assert len(got) == 6 or len(got) == 7
    text = "Title & x\n\nOne, two, three.\n\nFour five\n\na\n\nb"
    assert got[(1, len(text))] == text and got[(2, 0)] == got[(3, 0)] == got[(None, 0)] == "" and got[(5, 5)] == "x y z" and got[(4, 4)] == "deep"
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_mix_is_the_plain_one(spark, docs, sf):
    """Slots, ranks and words taken by plain loops, from where the documents lie in their source."""
    for d in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [r.asDict() for r in mixing.mix_sources(d).collect()]
        total = sum(r["size"] for r in rows)
        block = max(1, min(256, total >> 16))
        names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
        of = {s: [r for r in rows if r["source"] == s] for s in names}
        target = {s: of[s][0]["target"] for s in names}
        edges, upto = [], 0.0
        for s in names:
            upto += target[s]
            edges.append((upto / total, s))
        edges[-1] = (1.0, edges[-1][1])
        rank, times = Counter(), Counter()
        for k in range(-(-total // block)):
            x = (k * (5**0.5 - 1) / 2 + 0.5) % 1
            s = next(s for hi, s in edges if x < hi)
            blocks = -(-of[s][0]["source_size"] // block)
            if rank[s] < 3 * blocks:
                times[s, rank[s] % blocks] += 1
            rank[s] += 1
        far = 0
        for s in names:
            spans = sorted((r["start"], r["size"]) for r in of[s])
            at = 0
            for start, size in spans:  # end to end, without a gap
                assert start == at
                at += size
            for r in of[s]:
                want = sum(times[s, w // block] for w in range(r["start"], r["start"] + r["size"]))
                far += abs(want - r["taken"])
        assert far <= 2 * block  # a point on a border may fall to either side


def test_mixed_keeps_columns_of_any_name(spark):
    rows = [(k, "w " * (k % 7), k % 3, k, k, k) for k in range(60)] + [(None, "a b", 1, 1, 1, 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source int, row int, size int, times int")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    plan = {(r.doc_id, r.source, r["size"]): r for r in mixing.mix_sources(df).groupBy("doc_id", "source", "size").avg("taken").collect()}
    got = Counter(tuple(r) for r in out.collect())
    for row, n in Counter(rows).items():
        words = len(row[1].split())
        mean = plan[(row[0], str(row[2]), words)]["avg(taken)"] / words if words else 0
        assert got[row] == int(mean + 0.5) if n == 1 else n * math.floor(mean) <= got[row] <= n * math.ceil(mean)


def test_mixed_without_ids_meets_the_targets(spark):
    """Rows without ids and with texts of one length, and a row repeated to a third of all, are taken as often as planned."""
    rows = [(None, f"a{k} b{k} c", f"s{k % 3}") for k in range(600)] + [(5, "x y z", "s0")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r.source: r.target for r in mixing.mix_sources(df).select("source", "target").distinct().collect()}
    got = Counter(r.source for r in mixing.mixed(df).collect())
    for s, target in targets.items():
        assert abs(3 * got[s] - target) < 0.1 * target + 30, (s, 3 * got[s], target)


@pytest.fixture
def corpus(spark, tmp_path, sf):
    """A folder of tables with odd rows beside the given ones, and an extra column that stages use as a name."""

    def made(rows):
        where = str(tmp_path / f"c{len(rows)}")
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{where}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{where}/labels.parquet")
        return where

    return made


def test_pipeline(spark, sf, corpus):
    """Every stage on what the one before kept, against a plain version."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "z") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    odd = [(i, t, None, f"s{(i or 0) % 3}" if i != 100_004 else None, None, "q") for i, t in ((None if k is None else 100_000 + k, t) for k, t in TEXTS)]
    where = corpus(given + odd)
    at = spark.read.parquet(f"{where}/documents.parquet")
    rows = [tuple(r) for r in at.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, at, where))
        assert after.columns == at.columns
        got = Counter(tuple(r) for r in after.collect())
        if name == "toxicity":
            model = toxicity.learn(at, spark.read.parquet(f"{where}/labels.parquet"))
            classes = toxicity._Classes(model.lexicon)
            want = [r for r in rows if model.score(toxicity.features(r[1] or "", classes)) < 0.5]
            assert len(want) < len(rows)
        elif name == "exact_dedup":
            best = {}
            for r in rows:
                best[norm(r[1])] = min(r, best.get(norm(r[1]), r), key=lambda r: (order_of(r), str(r[2:])))
            want = list(best.values())
        elif name == "minhash_near_dedup":
            classes = plain_classes([r[:2] for r in rows])
            least = {c: min((r for r in rows if r[0] == c), key=lambda r: hashlib.md5((r[1] or "").encode()).digest()) for c in {c for _, c in classes} if c < 1 << 60}
            want = list(least.values()) + [r for r in rows if r[0] is None and (None, 1 << 60) in classes]
        else:
            plan = {(r.doc_id, r.source, r["size"]): r.taken for r in mixing.mix_sources(at).collect()}
            want = [r for r in rows if (n := len((r[1] or "").split(" ")) and len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for _ in range(int(plan[(r[0], r[3], n)] / n + 0.5))]
        assert got == Counter(want), name
        at, rows = after, list(got.elements())
    tokenizer, sha = Tokenizer.from_file(bpe.default_path()), lambda x: hashlib.sha256(x.encode()).hexdigest()
    coded = [(r[0], tokenizer.encode(r[1], add_special_tokens=False).ids) for r in rows]
    want = Counter((i, len(x), sha(" ".join(map(str, x))), sha(tokenizer.decode(x, skip_special_tokens=False))) for i, x in coded)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, where).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_pipeline_of_an_empty_table(spark, corpus):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, corpus([])).count() == 0


def test_registered(spark):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_url_paths_are_read_to_their_ends(spark):
    rules = (("h.example", "/a/b/c/d/e/bad/", "block"), ("h.example", "/a/b/c/d/e/good/", "allow"))
    urls = [f"http://h.example/a/b/c/d/e/{kind}/x/p{k}" for kind in ("bad", "good") for k in range(40)] + ["http://h.example/a/b/c/d/e/other/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, rules=rules).collect()}
    assert {got[k].template for k in range(40)} == {"/a/b/c/d/e/bad/x/*"} and {got[k].template for k in range(40, 80)} == {"/a/b/c/d/e/good/x/*"}
    assert got[80].template == "/a/b/c/d/e/other/x"


def test_media_digest_has_the_tiles(spark, docs):
    made = {}
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    for r in media.media_tiles(media.text_to_media(some, kind="bmp")).orderBy("media_id", "row", "col").collect():
        assert r.error is None
        made.setdefault(r.media_id, []).append(bytes(r.npy))
    got = {r.doc_id: (r.n_tiles, r.tiles_sha256) for r in media.media_digest(some).collect()}
    assert got == {i: (len(x), hashlib.sha256(b"".join(x)).hexdigest()) for i, x in made.items()} and got[9][0] > 1


def test_html_of_divs_only():
    long = "".join(f"<p>Long paragraph {k}, with many words, commas, and more of them, so that it has points, as it should.</p>" for k in range(12))
    page = f"""<body><div id=top><a href=/>Home</a></div><div><h1>Title</h1><h2>First</h2><div>{long}</div><h2>Second</h2><div><p>A short one.</p></div>
    <h3>Things</h3><ul><li>one thing</li><li>two things</li></ul><table><tr><td>cell</td></tr></table><figure><figcaption>A figure</figcaption></figure>
    <h2>Elsewhere</h2><ul><li><a href=/x>Some other page</a></li></ul></div></body>"""
    text = html_text.main_text(page).split("\n\n")
    assert text[:2] == ["Title", "First"] and text[14:] == ["Second", "A short one.", "Things", "one thing", "two things", "cell", "A figure"]


def test_html_keeps_unequal_sections():
    para = lambda k: f"<p>Paragraph {k} has some words, a comma, and an end that makes it long enough to have a few points.</p>"
    for a, b in ((8, 1), (6, 2), (10, 3), (1, 8), (3, 0)):
        section = lambda n, name: f"<div class=part><h2>{name}</h2>{''.join(map(para, range(n)))}</div>"
        for outer in ("div class=content", "article", "main", "section"):
            tag = outer.split()[0]
            page = f"<body><nav><a href=/>Home</a></nav><{outer}><h1>Title</h1>{section(a, 'One')}{section(b, 'Two')}</{tag}><div class=sidebar><p>Side, text, here.</p></div></body>"
            assert len(html_text.main_text(page).split("\n\n")) == 1 + (a + 1) + (b + 1 if b else int(outer in ("article", "main")) or 1), (a, b, outer)


def test_html_class_names():
    page = """<body><article><h1>T</h1><div class="form-factor"><p>One, two, three.</p></div><div class="search-results-explained"><p>Four, five.</p></div><div class="entry-header"><p>Head.</p></div>
    <div class="share"><p>Share of the market, in words.</p></div><div class="social-share"><a href=x>Tweet</a></div><div class="ad ad-12"><p>Buy, buy.</p></div><section id="comments2"><p>Nice!</p></section>
    <div class="related"><a href=a>Another page</a></div><div class="searchBox"><input> find</div><div class=cookie-notice>ok</div></article><div class="header"><p>Site</p></div></body>"""
    assert html_text.main_text(page).split("\n\n") == ["T", "One, two, three.", "Four, five.", "Head.", "Share of the market, in words."]


def test_html_loses_no_paragraph_of_an_article(spark, sf):
    """A plain reading of each page: the text of every p and heading inside its article stands in what is extracted."""
    import html as entities

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    seen = 0
    for r in html_text.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article[^>]*>(.*?)</article>", r.html or "", re.DOTALL)
        if not body:
            continue
        inner = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav|footer)\b.*?</\1>", "", body[1], flags=re.DOTALL)
        found = " ".join(r.text.split())
        for part in re.split(r"</?(?:p|h\d|li|ul|ol|div|blockquote|table|tr|td|th|pre|section)\b[^>]*>", inner):
            plain = " ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", part))).split())
            assert plain in found, (r.page_id, plain)
            seen += bool(plain)
    assert seen > 100


def test_queries_equal_their_sql(spark, sf):
    import duckdb

    for where in (sf, "/root/testdata/sf0.01"):
        c = duckdb.connect()
        for name in ("documents", "pages"):
            c.execute(f"create view {name} as select * from '{where}/{name}.parquet'")
        for name, sql in queries.oracle_sql().items():
            got = queries.queries()[name](spark, where)
            found = c.execute(sql)
            at = [[d[0] for d in found.description].index(x) for x in got.columns]
            assert Counter(map(tuple, got.collect())) == Counter(tuple(r[k] for k in at) for r in found.fetchall()), name


def test_urls_are_judged_by_merged_branches(spark):
    """A template that is blocked on all hosts which label it is blocked on a host that doesn't; one on which hosts differ isn't, nor one no host labels."""
    rules = (("a.org", "/spam/", "block"), ("b.org", "/spam/", "block"), ("a.org", "/news/", "allow"), ("b.org", "/news/", "allow"), ("a.org", "/mixed/", "block"), ("b.org", "/mixed/", "allow"))
    urls = [f"http://{h}/{d}/{h[0]}{k:02d}x" for h in ("a.org", "b.org", "c.org") for d in ("spam", "news", "mixed", "other") for k in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge_urls(pages, rules=rules).where("host = 'c.org'").collect()
    assert {(r.template, r.verdict, r.rule) for r in got} == {("/spam/*", "block", None), ("/news/*", "allow", None), ("/mixed/*", "allow", None), ("/other/*", "allow", None)}
    tied = url_filter.judge_urls(spark.createDataFrame([(1, "http://x.y.z/a/b")] * 2, "page_id long, url string"), rules=(("y.z", "/a/b", "block"), ("x.y.z", "/a", "allow"), ("x.y.z", "/a/b", "allow"), ("x.y.z", "/a/b", "block"))).collect()
    assert [(r.verdict, r.rule) for r in tied] == [("block", "x.y.z/a/b")] * 2
    deep = "http://d.org/" + "/".join(f"s{k}" for k in range(3000))
    assert url_filter.judge_urls(spark.createDataFrame([(1, deep), (1, deep), (2, "http://d.org//")], "page_id long, url string")).count() == 3


def plain_hash(rows):
    """Difference hash by the share of each pixel in each of 8 x 9 areas."""
    h, w = len(rows), len(rows[0])
    part = lambda a, b, k: max(0.0, min(b, k + 1) - max(a, k))
    means = [[sum(part(y * h / 8, (y + 1) * h / 8, i) * part(x * w / 9, (x + 1) * w / 9, j) * rows[i][j] for i in range(h) for j in range(w)) for x in range(9)] for y in range(8)]
    area = h * w / 72
    bits = "".join(str(int(row[x] / area < row[x + 1] / area - 1e-9)) for row in means for x in range(8))
    return f"{int(bits, 2):016x}"


def test_media_digest_is_the_plain_one(spark):
    r = random.Random(6)
    rows = [(k, "".join(chr(r.choice([32, 97, 98, 233, 12354, 128512])) for _ in range(r.randrange(900)))) for k in range(12)] + [(90, None), (91, "")]
    for x in media.media_digest(frame(spark, rows)).collect():
        raw = (dict(rows)[x.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        pixels = [[payload[i * 192 + j * 3 : i * 192 + j * 3 + 3] for j in range(64)] for i in range(len(payload) // 192)]
        stored = b"P6\n64 %d\n255\n" % len(pixels) + payload
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32, x.media_bytes, x.media_sha256) == want
        grey = [[0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2] for p in row] for row in pixels]
        assert x.feature == plain_hash(grey)
        tile = np.floor(np.array(grey) + 0.5).astype(np.uint8)
        assert x.n_tiles == 1 and x.tile_hashes_sha256 == hashlib.sha256(plain_hash(tile.tolist()).encode()).hexdigest()
