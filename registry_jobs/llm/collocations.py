"""Phrase collocations by prefix-free parsing.

Texts are parsed into chunks at content triggers: a window of OVERLAP words whose hash falls on a trigger ends
a chunk and begins the next, so equal passages have equal chunks wherever they stand. Distinct chunks with their
frequencies are the dictionary; n-grams are counted once inside each distinct chunk, weighted by its frequency.
An n-gram belongs to the chunk in which it begins before the closing window, and lies wholly in it, as the
window holds one word fewer than the longest phrase; so overlaps are counted once.

The dictionary is packed into batches. Before phrases become strings, words and pairs of words are pruned by a
semi-join in two hops without any broadcast: each batch sends 48-bit hashes of its words and pairs with their
counts to buckets, buckets add them up and send back those that may be frequent. Equal hashes only add counts,
so no frequent phrase is lost; what comes back is counted exactly, as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from registry_jobs.llm.common import dropped, join_counted, mix, span_hashes, text_or_empty, text_slices, words, written
from registry_jobs.sources.tables import width

_U = np.uint64
LONGEST = 5
OVERLAP = LONGEST - 1
TRIGGER = 32  # one window of so many is a trigger: chunks have about as many words
LEAST = 100
BEST = 2000
#: Bytes of chunks in a batch, and batches that a bucket serves.
BATCH = 1 << 23
SHARE = 2
KEY = 6  # bytes of a hash that are sent

BREAKS = ".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in BREAKS]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_EDGE = _BREAK | _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of data one after the other, and where each begins."""
    ends = np.cumsum(lengths)
    offsets = np.concatenate(([0], ends))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[at], offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row, open): lower-cased words, each followed by a blank, or by a line end where its piece ends.

    open: whether the next word of the row stands in the same piece.
    """
    data = _LOWER[data]
    starts, ends, rows = words(data, offsets, _EDGE)
    if not len(starts):
        return data, starts, ends, rows, np.zeros(0, bool)
    broken = np.concatenate(([0], np.cumsum(_BREAK[data])))
    same = np.zeros(len(starts), dtype=bool)
    same[:-1] = (rows[1:] == rows[:-1]) & (broken[ends[:-1]] == broken[starts[1:]])
    length = ends - starts
    out, at = gathered(np.append(data, np.uint8(0)), starts, length + 1)
    out[at[1:] - 1] = np.where(same, 32, 10)
    return out, at[:-1], at[:-1] + length, rows, same


def chunk_spans(hashes: np.ndarray, rows: np.ndarray, overlap: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word behind the last, last of its row) of the chunks of each row's words."""
    n = len(hashes)
    new = np.ones(n, dtype=bool)
    new[1:] = rows[1:] != rows[:-1]
    row_at = np.flatnonzero(new)
    row_end = np.append(row_at[1:], n)
    begins = new.copy()
    if n >= overlap:
        with np.errstate(over="ignore"):
            acc = np.zeros(n - overlap + 1, _U)
            for k in range(overlap):
                acc = acc * _U(0xD1B54A32D192ED03) + hashes[k : n - overlap + 1 + k]
        hit = mix(acc) % _U(trigger) == 0
        begins[: n - overlap + 1] |= hit & (rows[: n - overlap + 1] == rows[overlap - 1 :])
    first = np.flatnonzero(begins)
    after = np.append(first[1:], n)
    which = np.searchsorted(row_at, first, side="right") - 1
    last = after == row_end[which]
    return first, np.where(last, after, after + overlap), last


def _parse(overlap: int, trigger: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, data, offsets in text_slices(batch.column(1)):
                data, starts, ends, rows, _ = plain_words(data, offsets)
                if not len(starts):
                    continue
                first, after, last = chunk_spans(span_hashes(data, starts, ends), rows, overlap, trigger)
                chunk = strings(*gathered(data, starts[first], ends[after - 1] - starts[first]))
                langs = batch.column(0).take(pa.array(first_row + rows[first]))
                yield pa.RecordBatch.from_arrays([langs, pa.array(last), chunk.cast(pa.string())], names=["lang", "last", "chunk"])

    return parse


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """(lang, last, chunk, times): the distinct chunks of all texts; `last` chunks end with their text, others with a trigger."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(_parse(longest - 1, trigger), "lang string, last boolean, chunk string").groupBy("lang", "last", "chunk").agg(F.count(F.lit(1)).alias("times"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BATCH bytes of chunks."""
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        one = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), c.chunk(0)) for c in whole.columns]
        return pa.RecordBatch.from_arrays(one, names=whole.column_names)

    for batch in batches:
        for first, data, offsets in text_slices(batch.column(2), BATCH >> 3):
            held.append(batch.slice(first, len(offsets) - 1))
            size += len(data)
            if size >= BATCH:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


class _Batch:
    """The words of a batch of distinct chunks: spans, hashes by language, weights and counted starts."""

    def __init__(self, langs: pa.Array, lasts: pa.Array, chunks: pa.Array, times: pa.Array, overlap: int):
        coded = langs.dictionary_encode()
        self.langs, code = coded.dictionary, coded.indices.to_numpy()
        text = chunks.cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
        data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        self.data, offsets = data, offsets - offsets[0]
        self.starts, self.ends, rows = words(data, offsets, _EDGE)
        self.open = np.zeros(len(rows), dtype=bool)
        self.open[:-1] = (data[self.ends[:-1]] == 32) & (rows[1:] == rows[:-1])
        self.code = code[rows]
        self.times = times.to_numpy()[rows]
        n = np.bincount(rows, minlength=len(text))
        place = np.arange(len(rows)) - (np.cumsum(n) - n)[rows]
        self.counted = lasts.to_numpy(zero_copy_only=False)[rows] | (place < n[rows] - overlap)
        with np.errstate(over="ignore"):
            name = [np.frombuffer(f"{x}|".encode(), np.uint8) for x in self.langs.to_pylist()]
            lang = np.array([span_hashes(x, np.array([0]), np.array([len(x)]))[0] for x in name], _U)
            self.words = mix(span_hashes(data, self.starts, self.ends) ^ lang[self.code])
            self.pairs = np.zeros(len(rows), _U)
            self.pairs[:-1] = mix(self.words[:-1] * _U(0x9E3779B97F4A7C15) + self.words[1:])
        self.words, self.pairs = self.words >> _U(64 - 8 * KEY), self.pairs >> _U(64 - 8 * KEY)


def _six(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes()


def _eight(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    return out.view("<u8").reshape(-1)


def _unpacked(batch: pa.RecordBatch, k: int, overlap: int) -> _Batch:
    return _Batch(*[batch.column(j)[k].values for j in range(1, 5)], overlap)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _send(overlap: int, buckets: int, least: int):
    """Hashes of a batch's words and pairs with counts, at most `least`, dealt to buckets.

    Those of closing windows, counted elsewhere, are asked for with 0: phrases that begin before the window end in it.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = _unpacked(batch, k, overlap)
                times = np.where(b.counted, b.times, 0)
                keys, n = summed(np.concatenate([b.words, b.pairs[b.open]]), np.concatenate([times, times[b.open]]))
                n = np.minimum(n, least).astype("<u4")
                to = (keys % _U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=buckets))))
                keys, n = keys[order], n[order]
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([batch.column(0)[k].as_py()] * len(some), pa.int64()), pa.array([_six(keys[cut[s] : cut[s + 1]]) for s in some], pa.binary()), pa.array([n[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary())],
                    names=["bucket", "batch", "keys", "n"],
                )

    return send


def _answer(least: int):
    """Of each batch's hashes those that reach `least` over all batches."""

    def answer(group: pa.Table) -> pa.Table:
        sent = [_eight(x.as_py()) for x in group["keys"]]
        keys, n = summed(np.concatenate(sent), np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in group["n"]]).astype(np.int64))
        often = keys[n >= least]
        back = [_six(s[np.isin(s, often, assume_unique=True)]) for s in sent]
        return pa.table({"batch": group["batch"], "often": pa.array(back, pa.binary())}).filter(pa.array([len(x) > 0 for x in back]))

    return answer


def _phrases(overlap: int, buckets: int):
    """The phrases of each batch whose words and pairs may all be frequent, counted and dealt to buckets: a row a language and bucket with lists
    of words, phrase and n. Words 0 counts all words of the language."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = _unpacked(batch, k, overlap)
                often = [x.as_py() for x in batch.column(5)[k].values] if batch.column(5)[k].is_valid else []
                often = np.sort(np.concatenate([_eight(x) for x in often])) if often else np.zeros(0, _U)
                total = np.bincount(b.code[b.counted], weights=b.times[b.counted], minlength=len(b.langs)).astype(np.int64)
                found = [pa.table({"code": pa.array(np.arange(len(total)), pa.int64()), "words": pa.array([0] * len(total), pa.int32()), "phrase": pa.array([""] * len(total), pa.large_string()), "n": pa.array(total)})]
                if len(often):
                    word, pair = _among(b.words, often), _among(b.pairs, often) & b.open
                    pair[:-1] &= word[:-1] & word[1:]
                    on = word & b.counted
                    for m in range(1, overlap + 2):
                        if m > 1:
                            more = np.zeros(len(pair), dtype=bool)
                            more[: len(pair) - m + 2] = pair[m - 2 :]
                            on = on & more
                        at = np.flatnonzero(on)
                        found += [_counted(b, at[lo : lo + (1 << 18)], m) for lo in range(0, len(at), 1 << 18)]
                yield _dealt(b.langs, pa.concat_tables(found).combine_chunks(), buckets)

    return phrases


def _dealt(langs: pa.Array, found: pa.Table, buckets: int) -> pa.RecordBatch:
    phrase, code = found["phrase"].chunk(0), found["code"].to_numpy()
    offsets = np.frombuffer(phrase.buffers()[1], np.int64, len(phrase) + 1 + phrase.offset)[phrase.offset :]
    data = phrase.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    # the empty phrase begins on a byte of the data, and goes to one bucket whether a batch has other phrases or not
    to = (span_hashes(data, np.minimum(offsets[:-1], len(data) - 1), np.maximum(offsets[1:], np.minimum(offsets[:-1], len(data) - 1))) % _U(buckets)).astype(np.int64)
    order = np.lexsort((to, code))
    code, to, found = code[order], to[order], found.take(pa.array(order))
    at = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (to[1:] != to[:-1]))))
    cut = pa.array(np.append(at, len(code)), pa.int32())
    kept = [pa.ListArray.from_arrays(cut, found[c].combine_chunks().cast(t)) for c, t in (("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()))]
    return pa.RecordBatch.from_arrays([langs.take(pa.array(code[at])), pa.array(to[at], pa.int32()), *kept], names=["lang", "bucket", "words", "phrase", "n"])


def _added(least: int):
    """The exact counts of a bucket's phrases that reach `least`, and the words of the language."""

    def added(group: pa.Table) -> pa.Table:
        flat = pa.table({c: group[c].combine_chunks().flatten() for c in ("words", "phrase", "n")}).group_by(["words", "phrase"]).aggregate([("n", "sum")])
        stays = pc.or_(pc.greater_equal(flat["n_sum"], least), pc.equal(flat["words"], 0))
        flat = flat.filter(stays)
        return pa.table({"lang": pa.array([group["lang"][0].as_py()] * len(flat), pa.string()), "words": flat["words"], "phrase": flat["phrase"], "n": flat["n_sum"]})

    return added


def _among(keys: np.ndarray, often: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(often, keys), len(often) - 1)
    return often[at] == keys


def _counted(b: _Batch, at: np.ndarray, m: int) -> pa.Table:
    text = strings(*gathered(b.data, b.starts[at], b.ends[at + m - 1] - b.starts[at]))
    table = pa.table({"code": pa.array(b.code[at], pa.int64()), "phrase": text, "n": pa.array(b.times[at], pa.int64())})
    found = table.group_by(["code", "phrase"]).aggregate([("n", "sum")])
    return pa.table({"code": found["code"], "words": pa.array(np.full(len(found), m), pa.int32()), "phrase": found["phrase"], "n": found["n_sum"]})


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, trigger: int = TRIGGER) -> DataFrame:
    """(lang, words, phrase, n), written: exact counts of all phrases of up to `longest` words that occur `least` times, and of all words as words 0."""
    overlap = longest - 1
    packed = dictionary(docs, lang_col, text_col, longest, trigger).mapInArrow(_pack, "lang array<string>, last array<boolean>, chunk array<string>, times array<long>")
    batches = written(packed.select(F.monotonically_increasing_id().alias("batch"), "*"))
    buckets = max(width(docs.sparkSession), batches.count() // SHARE)
    sent = batches.mapInArrow(_send(overlap, buckets, least), "bucket int, batch long, keys binary, n binary")
    back = sent.groupBy("bucket").applyInArrow(_answer(least), "batch long, often binary").groupBy("batch").agg(F.collect_list("often").alias("often"))
    # a batch has at most as many hashes as its own words and pairs
    met = batches.join(back.hint("merge"), "batch", "left").select(*batches.columns, "often")
    dealt = met.mapInArrow(_phrases(overlap, buckets), "lang string, bucket int, words array<int>, phrase array<string>, n array<long>")
    out = written(dealt.groupBy("bucket", "lang").applyInArrow(_added(least), "lang string, words int, phrase string, n long"))
    dropped(batches)
    return out


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases of two and more words, by their lowest-scoring cut."""
    phrases = counts.where((F.col("words") > 1) & (F.col("n") >= least)).select("lang", "phrase", "words", F.col("n").alias("a"))
    part = F.split("phrase", " ")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(part, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(part, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    known = counts.where("words > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")).hint("merge"), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")).hint("merge"), ["lang", "right"])
    rows = written(cuts.select("lang", "phrase", "words", "a", "k", "l", "r"))
    langs = counts.where("words = 0").select("lang", "n").join(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("times")), "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    whole = join_counted(rows, langs, ["lang"], rows.count()).withColumn("up", exact("a") * exact("n") * F.lit(1000).cast("decimal(38,0)")).withColumn("down", exact("l") * exact("r"))
    whole = whole.withColumn("score", F.expr("up div down").cast("long"))
    lowest = whole.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("c"))
    out = written(lowest.select("lang", "phrase", "c.*").drop("k"))
    dropped(rows)
    return out


def without_parts(found: DataFrame) -> DataFrame:
    """found without phrases that lie in a longer one of the same count: one word longer at most, as counts fall with length."""
    part = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(part, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(part, F.lit(2), F.col("words") - 1), " "))
    longer = found.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(longer.hint("merge"), ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")


def top(found: DataFrame, best: int) -> DataFrame:
    """The first `best` of each language with their rank: first within hashed parts of a language, then over what these leave."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = width(found.sparkSession)
    inner = Window.partitionBy("lang", "part").orderBy(*order)
    left = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(inner)).where(F.col("rank") <= best)
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best).drop("part")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, best: int = BEST, trigger: int = TRIGGER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `best` collocations of each language.

    A phrase has 2 to `longest` words of one piece of a text (A-Z lower-cased; pieces end at .,;:!? and line
    ends, words at blanks and tabs) and occurs a >= `least` times. It is scored by its lowest-scoring cut
    into a first part (l times) and a rest (r times): floor(1000 * a * n / (l * r)), n words in all.
    Phrases inside a longer one of the same count are left out. A null text is empty, a null language
    `und`; each row of a repeated one counts; a text of any length is parsed whole, a text without words
    or an empty table gives nothing. Ties go by a, then by the phrase's bytes. Columns besides the two
    named are not read.
    """
    counts = phrase_counts(docs, lang_col, text_col, longest, least, trigger)
    found = scored(counts, least)
    out = written(top(without_parts(found), best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    dropped(counts, found)
    return out.withColumn("rank", F.col("rank").cast("long"))
