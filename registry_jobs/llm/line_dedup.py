"""Line dedup by winnowing over line hashes.

A document is the row of its lines that aren't blank. A gram begins at each line: the shortest run of lines
from there on with `least` lines or, where `enough` is given, with so many words. Every window of `window`
consecutive grams gives its minimum as a fingerprint, and a gram that has the words by itself is always one,
as a passage may hold no other. Fingerprints travel with their position and with the lines beside them;
equal ones are joined with their first occurrence, and each match is extended both ways by comparing lines.
Matches that overlap or touch are runs, and later runs are deleted.

Lines and grams are known by 128-bit BLAKE2b digests of their bytes. What is deleted is digested anew from the
text at hand and compared with the digests that came from the earlier text: no line goes on a mere hash key.
The order of the corpus is that of ids, then of lines. No group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry_jobs.llm.common import dropped, join_counted, text_or_empty, written

LEAST = 3
ENOUGH = 50
WINDOW = 2
SIZE = 16
BLANK = b" \t\n\x0b\x0c\r"


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=SIZE).digest()


def solid_lines(text: str) -> tuple[list[bytes], np.ndarray]:
    """Digest and number of words of each line with a word in it, in order; white space at a line's ends isn't digested."""
    lines = [x for line in text.encode("utf-8", "surrogatepass").split(b"\n") if (x := line.strip(BLANK))]
    return [digest(x) for x in lines], np.array([len(x.split()) for x in lines], np.int64)


def grams(sizes: np.ndarray, least: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of lines, whether it has the words) of the gram at each line that begins one; its first lines do.

    A text with fewer lines than `least` and without the words is one gram of all its lines.
    """
    n = len(sizes)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    length = np.full(n, least)
    if enough:
        length = np.minimum(length, np.searchsorted(upto, upto[:-1] + enough) - np.arange(n))
    length = length[np.arange(n) + length <= n]
    if not len(length):
        return np.array([n], np.int64)[: n > 0], np.zeros(min(n, 1), bool)
    at = np.arange(len(length))
    return length, (upto[at + length] - upto[at] >= enough) if enough else np.zeros(len(length), bool)


def fingerprints(lines: list[bytes], sizes: np.ndarray, least: int, enough: int, window: int) -> Iterator[tuple[int, int, bytes]]:
    """(first line, number of lines, digest) of the chosen grams; of equal minima in a window all are chosen."""
    length, sure = grams(sizes, least, enough)
    short = len(length) == 1 and length[0] < least and not sure[0]
    names = [digest((b"all" if short else b"") + b"".join(lines[p : p + n])) for p, n in enumerate(length.tolist())]
    order = np.array([int.from_bytes(x[:8], "big") for x in names], np.uint64)
    chosen = sure.copy()
    m = len(order) - window + 1
    if m < 1:
        chosen[order == order.min(initial=np.iinfo(np.uint64).max)] = True
    else:
        stack = np.stack([order[k : k + m] for k in range(window)])
        least_here = stack.min(axis=0)
        for k in range(window):
            chosen[k : k + m] |= stack[k] == least_here
    for p in np.flatnonzero(chosen).tolist():
        yield p, int(length[p]), names[p]


def _prints(least: int, enough: int, window: int):
    names = ["doc_id", "text_key", "pos", "n", "a", "b", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
            row, pos, n, name, before, after = zip(*rows, strict=True)
            take = pa.array(row)
            key = np.frombuffer(b"".join(name), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=names
            )

        for batch in batches:
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(2)):
                lines, sizes = solid_lines(text.as_py())
                for p, n, name in fingerprints(lines, sizes, least, enough, window):
                    rows.append((k, p, n, name, b"".join(lines[max(0, p - window + 1) : p]), b"".join(lines[p + n : p + n + window - 1])))
                if len(rows) > 20_000:
                    yield made(batch, rows)
                    rows = []
            if rows:
                yield made(batch, rows)

    return run


def matched(lines: list[bytes], marks: list[tuple[int, int, bytes, bytes, bytes]]) -> list[list[int]]:
    """Runs [first, last] of lines that the marks (first line, number, digest, lines before, lines after) verify and extend to."""
    runs: list[list[int]] = []
    for p, n, name, before, after in sorted(marks):
        here = b"".join(lines[p : p + n])
        if name not in (digest(here), digest(b"all" + here)):
            continue
        first, last = p, p + n - 1
        while first and before and lines[first - 1] == before[-SIZE:]:
            first, before = first - 1, before[:-SIZE]
        while last + 1 < len(lines) and after and lines[last + 1] == after[:SIZE]:
            last, after = last + 1, after[SIZE:]
        runs.append([first, last])
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of their runs; lines are counted without the blank ones."""
    for batch in batches:
        texts, removed, spans, totals = [], [], [], []
        for text, marks in zip(batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            lines = text.split("\n")
            solid = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
            runs = []
            if marks.is_valid:
                marks = [(m["pos"], m["n"], int(m["a"]).to_bytes(8, "little", signed=True) + int(m["b"]).to_bytes(8, "little", signed=True), m["before"], m["after"]) for m in marks.as_py()]
                runs = matched(solid_lines(text)[0], marks)
                gone = {solid[k] for first, last in runs for k in range(first, last + 1)}
                text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
            texts.append(text)
            totals.append(len(solid))
            removed.append(sum(b - a + 1 for a, b in runs))
            spans.append(",".join(f"{a}-{b}" for a, b in runs))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.string())], names=["doc_id", "text", "n_lines", "n_removed", "removed"]
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, enough: int = 0, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_lines, n_removed, removed: one row per row of docs, with later repeated runs deleted.

    A run stands earlier in a document with a smaller id or further up. Each deleted line lies in a run of at
    least `least` lines, or with `enough` of so many words, that stands earlier. Each run of least + window - 1
    lines, or with `enough` each of so many words, that stands earlier is found, and deleted but for at most
    window - 1 lines at its ends, where its fingerprints stand still earlier beside other lines. Shorter runs
    of `least` lines go where they hold a fingerprint. Lines are compared without white space at their ends,
    and blank lines neither count nor end a run nor go. A text with fewer lines goes as a whole when an earlier
    text of the same few lines exists. removed lists runs as first-last, lines from 0 without the blank ones.

    Null is empty; null ids come last, their texts in the order of a hash; rows repeated with id and text are
    one document, and each has its result; of equal texts the one with the smallest id stays; other columns
    are not read; an empty table gives an empty result. A text of any length is one row.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, text_key long, pos int, n int, a long, b long, before binary, after binary"
    found = written(base.select("doc_id", "text_key", "text").mapInArrow(_prints(least, enough, window), schema))
    place = [F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"), F.col("pos")]
    firsts = found.groupBy("a", "b").agg(F.min(F.struct(*place, F.col("before"), F.col("after"))).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    firsts = written(firsts.select("a", "b", "times", F.struct("first.none", "first.doc_id", "first.text_key", "first.pos").alias("first"), F.col("first.before").alias("before"), F.col("first.after").alias("after")))
    later = join_counted(found.drop("before", "after"), firsts, ["a", "b"], found.count()).where(F.struct(*place) > F.col("first"))
    marks = later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "n", "a", "b", "before", "after")).alias("marks"))  # within one document
    marks = written(marks.select(F.col("doc_id").alias("mark_id"), F.col("text_key").alias("mark_key"), "marks"))
    dropped(found, firsts)
    both = base["doc_id"].eqNullSafe(marks["mark_id"]) & (base["text_key"] == marks["mark_key"])
    out = base.join(marks.hint("merge"), both, "left")
    return out.select("doc_id", "text", "marks").mapInArrow(_cut, "doc_id long, text string, n_lines long, n_removed long, removed string")
