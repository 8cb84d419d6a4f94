"""Exact dedup by counting quotient filters.

Each partition of the corpus builds counting quotient filters over 64-bit fingerprints of its normalised
texts. A filter is a table of slots: the high bits of a fingerprint, its quotient, name the home slot, and its
low bits, the remainder, stand in the quotient's run of sorted remainders, at home or shifted behind the
runs before it. Three bits a slot (occupied, continuation, shifted) tell runs and homes; a fourth marks slots
that hold digits of the counter of the remainder before them, as many as the count needs and none for one.

A filter covers one block of the fingerprint space, so equal blocks of all partitions meet in one task and
merge by their sorted remainders, without loss. A copy group, however large, is one counted remainder in
each partition's filter. Fingerprints with a merged count above one go to byte verification, which groups the
texts themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry_jobs.llm.common import WS, dropped, join_counted, keep_rows, text_or_empty, written

_U = np.uint64
FULLEST = 0.85  # share of a filter's slots in use, at most
OCCUPIED, CONTINUATION, SHIFTED, COUNTER = range(4)


def encode_filter(values: np.ndarray, counts: np.ndarray, low_bits: int) -> tuple[int, bytes, bytes]:
    """(quotient bits, packed metadata bits, remainders) of sorted distinct values below 2**low_bits and their counts."""
    digits = np.zeros(len(values), np.int64)
    over = counts.astype(_U) - _U(1)  # in digits of eight bits, the lowest first
    while (more := over >> (digits.astype(_U) * _U(8)) > 0).any():
        digits += more
    used = int(len(values) + digits.sum())
    q_bits = min(low_bits - 8, max(1, math.ceil(math.log2(max(used, 1) / FULLEST + 1))))
    r_bits = low_bits - q_bits
    quotient = (values >> _U(r_bits)).astype(np.int64)
    # entry i, with its counter, begins at home or right behind the entry before it
    width = digits + 1
    before = np.concatenate(([0], np.cumsum(width)[:-1]))
    at = np.maximum.accumulate(quotient - before) + before
    size = max(1 << q_bits, int(at[-1] + width[-1]))
    bits = np.zeros((4, size), bool)
    slots = np.zeros(size, _U)
    slots[at] = values & ((_U(1) << _U(r_bits)) - _U(1))
    bits[OCCUPIED, quotient] = True
    bits[CONTINUATION, at[1:][quotient[1:] == quotient[:-1]]] = True
    bits[SHIFTED, at[at != quotient]] = True
    k = 0
    while (more := digits > k).any():
        slots[at[more] + 1 + k] = (over[more] >> _U(8 * k)) & _U(255)
        bits[COUNTER, at[more] + 1 + k] = True
        k += 1
    n_bytes = (r_bits + 7) // 8
    return q_bits, np.packbits(bits, axis=1).tobytes(), slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].tobytes()


def decode_filter(q_bits: int, metadata: bytes, remainders: bytes, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and counts of a filter, read from its slots and bits alone."""
    r_bits = low_bits - q_bits
    n_bytes = (r_bits + 7) // 8
    slots = np.zeros((len(remainders) // n_bytes, 8), np.uint8)
    slots[:, :n_bytes] = np.frombuffer(remainders, np.uint8).reshape(-1, n_bytes)
    slots = slots.reshape(-1).view("<u8")
    bits = np.unpackbits(np.frombuffer(metadata, np.uint8).reshape(4, -1), axis=1)[:, : len(slots)].astype(bool)
    homes = np.flatnonzero(bits[OCCUPIED])
    entry = bits[CONTINUATION] | bits[SHIFTED] | (bits[OCCUPIED] & ~bits[COUNTER])
    at = np.flatnonzero(entry)
    # runs stand in the order of the quotients that are occupied
    run = np.cumsum(~bits[CONTINUATION][at]) - 1
    counts = np.ones(len(at), np.int64)
    for k in range(8):
        place = np.minimum(at + 1 + k, len(slots) - 1)
        more = bits[COUNTER][place] & (at + 1 + k < len(slots))
        if k:
            more &= last
        last = more
        if not more.any():
            break
        counts += np.where(more, slots[place].astype(np.int64) << (8 * k), 0)
    return (homes[run].astype(_U) << _U(r_bits)) | slots[at], counts


def merge_sorted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal entries of concatenated sorted runs as one, counts added."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new], np.add.reduceat(counts, np.flatnonzero(new)) if len(values) else counts


_FILTER = pa.schema([("block", pa.int32()), ("q_bits", pa.int32()), ("metadata", pa.binary()), ("remainders", pa.binary())])
_REPEATED = pa.schema([("fp", pa.int64()), ("copies", pa.int64())])


def _build(block_bits: int, flush: int):
    low_bits = 64 - block_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(values: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            block = (values >> _U(low_bits)).astype(np.int64)
            low = values & ((_U(1) << _U(low_bits)) - _U(1))
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=1 << 62))
            for first in range(0, len(edges) - 1, 1000):
                ends = edges[first : first + 1001]
                rows = [(int(block[a]), *encode_filter(low[a:b], counts[a:b], low_bits)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _FILTER, strict=True)], schema=_FILTER)

        values, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        for batch in batches:
            got = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            values, counts = merge_sorted(np.concatenate([values, got]), np.concatenate([counts, np.ones(len(got), np.int64)]))
            if len(values) >= flush:
                yield from filters(values, counts)
                values, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        if len(values):
            yield from filters(values, counts)

    return build


def _merge(block_bits: int):
    low_bits = 64 - block_bits

    def merge(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        parts = [decode_filter(q.as_py(), m.as_py(), r.as_py(), low_bits) for q, m, r in zip(block["q_bits"], block["metadata"], block["remainders"], strict=True)]
        values, counts = merge_sorted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        more = counts > 1
        fp = (values[more] | (_U(key[0].as_py()) << _U(low_bits))).view(np.int64)
        return pa.table([pa.array(fp), pa.array(counts[more])], schema=_REPEATED)

    return merge


def blocks_for(rows: int) -> int:
    """Bits of the number of blocks: 64 blocks at least, and at most some 2**18 fingerprints in each."""
    return min(24, max(6, math.ceil(math.log2(max(rows, 1))) - 18))


def repeated_fingerprints(prints: DataFrame, block_bits: int, flush: int = 1 << 21) -> DataFrame:
    """(fp, copies) for each fingerprint of the one-column frame `prints` that occurs more than once.

    The fingerprint space is split into 2**block_bits blocks. flush: entries after which a task emits its
    filters and begins others, which bounds its memory.
    """
    filters = prints.mapInArrow(_build(block_bits, flush), "block int, q_bits int, metadata binary, remainders binary")
    return filters.groupBy("block").applyInArrow(_merge(block_bits), "fp long, copies long")


def _normal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(text_or_empty(text_col), WS, " ").alias("norm"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, block_bits: int | None) -> tuple[DataFrame, DataFrame]:
    """rows (rid, doc_id, fp, text_sha256), one a row of docs, and groups (text_sha256, keep_rid, keep_id, times) of repeated texts."""
    base = _normal(docs, id_col, text_col)
    rows = written(base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")))
    repeated = written(repeated_fingerprints(rows.select("fp"), blocks_for(rows.count()) if block_bits is None else block_bits))
    # Byte verification: the texts themselves are the grouping key, copies are counted before the shuffle.
    texts = base.withColumn("fp", F.xxhash64("norm")).join(repeated, "fp", "left_semi")
    same = texts.groupBy("norm").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.sha2("norm", 256).alias("text_sha256"), "times")
    # the row that stays: no id is behind all ids
    first = rows.join(repeated.hint("merge"), "fp", "left_semi").groupBy("text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    groups = written(same.join(first.hint("merge"), "text_sha256").select("text_sha256", F.col("first.rid").alias("keep_rid"), F.col("first.doc_id").alias("keep_id"), "times"))
    dropped(repeated)
    return rows, groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bits: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is one space; null is empty. The row
    with the smallest id stays. Null ids come last: such a row stays only in a group with no other id.
    Of rows repeated with id and text, one stays. An empty table gives an empty result; columns besides
    id and text are not read, whatever their names. A text of any length is one row. block_bits follows
    the number of rows unless given.
    """
    rows, groups = _grouped(docs, id_col, text_col, block_bits)
    found = join_counted(rows, groups, ["text_sha256"], rows.count(), "left")
    alone = F.col("times").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("times", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bits: int | None = None) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their own columns, whatever their names.

    Of rows equal in id and text the one stays whose other columns come first as JSON text.
    """
    rows, groups = _grouped(docs, id_col, text_col, block_bits)
    n_rows, key = rows.count(), ["text_sha256"]
    # of each repeated text: the id that stays, and how many rows have both
    same = join_counted(rows, groups, key, n_rows).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("same"))
    stays = written(groups.select(F.col("text_sha256").alias("key"), "keep_id", "times", F.lit(True).alias("keeps")).join(same.withColumnRenamed("text_sha256", "key").hint("merge"), "key"))
    dropped(rows, groups)
    return keep_rows(docs, id_col, text_col, F.sha2(F.regexp_replace(text_or_empty(text_col), WS, " "), 256), stays, n_rows)
