"""Shared helpers: joins that keep hot keys apart, and word hashing over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registry_jobs.sources.tables import dropped, scratch_dir, table, written  # noqa: F401

#: White space as the contracts define it: U+0020 and U+0009 to U+000D.
WS = "[\\x20\\x09-\\x0D]+"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_COMB = 0xD1B54A32D192ED03
#: Bytes up to which a span is hashed by numpy.
LONG = 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


HOT = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n_rows: int, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with keyed, which has one row a key and in `times` how many rows have it.

    A key with more than a thousandth of all rows is hot. There are fewer than a thousand of them, so they
    are broadcast, and their rows are dealt out by the partition they come from; the rest is sorted and merged.
    """
    values = F.struct(*[c for c in keyed.columns if c not in on])
    hot = keyed.where(F.col("times") * F.lit(HOT) > F.lit(n_rows)).select(*on, values.alias("hot_values"))
    cold = keyed.where(F.col("times") * F.lit(HOT) <= F.lit(n_rows)).select(*on, F.lit(0).alias("deal"), values.alias("cold_values"))
    met = rows.join(F.broadcast(hot), on, "left").withColumn("deal", F.when(F.col("hot_values").isNull(), 0).otherwise(F.spark_partition_id() + 1))
    met = met.join(cold.hint("merge"), [*on, "deal"], "left").withColumn("hot_values", F.coalesce("hot_values", "cold_values"))
    if how == "inner":
        met = met.where(F.col("hot_values").isNotNull())
    return met.select(*rows.columns, "hot_values.*")


def keep_rows(docs: DataFrame, id_col: str, text_col: str, key: Column, stays: DataFrame, n_rows: int) -> DataFrame:
    """The rows of docs that stay, with their own columns, whatever their names.

    stays has a row for each text that more than one row has or that goes: `key` of the text, `times`, `keeps`
    whether a row of it stays, `keep_id` of that row, and `same`, how many rows have text and id. Of these
    the one stays whose other columns come first as JSON text.
    """
    cols = docs.columns
    whole = docs.select(F.struct(*cols).alias("row"), F.col(id_col).cast("long").alias("doc_id"), key.alias("key"))
    fits = F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = join_counted(whole, stays, ["key"], n_rows, "left").where(F.col("same").isNull() | (fits & (F.col("same") == 1))).select("row")
    more = stays.where("keeps and same > 1")
    if not more.isEmpty():
        rest = [F.col("row")[c] for c in cols if c not in (id_col, text_col)]
        first = F.min_by("row", F.to_json(F.struct(*rest)) if rest else F.lit(""))
        out = out.unionByName(join_counted(whole, more, ["key"], n_rows).where(fits).groupBy("key").agg(first.alias("row")).select("row"))
    return out.select("row.*")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_slices(column: pa.Array, most: int = 1 << 20):
    """(first row, bytes, row offsets) of consecutive rows with about `most` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: its length and its words of eight bytes, mixed in one after the other.

    Spans beyond LONG bytes, which numpy would take in many short steps, go through xxHash.
    """
    n = ends - starts
    out = mix(n.astype(_U) * _U(_COMB) + _U(_BASE))
    if not len(n):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data), "<u8", padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        left, at, todo = n, starts, None
        short = n <= LONG
        if not short.all():
            todo = np.flatnonzero(short)
            left, at = n[short], starts[short]
            for k in np.flatnonzero(~short):
                out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
        while len(left):
            part = eights[at]
            cut = left < 8
            part = np.where(cut, part & ((_U(1) << (np.minimum(left, 7).astype(_U) * _U(8))) - _U(1)), part)
            if todo is None:
                out = mix(out ^ part * _U(_BASE))
            else:
                out[todo] = mix(out[todo] ^ part * _U(_BASE))
            more = left > 8
            todo = np.flatnonzero(more) if todo is None else todo[more]
            left, at = left[more] - 8, at[more] + 8
    return out


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a longest run of bytes outside `space` within one row."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `size` words; a row with fewer words, but one, has one shingle of them all."""
    starts, ends, rows = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n_rows = len(offsets) - 1
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    with np.errstate(over="ignore"):
        if len(hashes) >= size:
            m = len(hashes) - size + 1
            acc = np.zeros(m, _U)
            for k in range(size):
                acc = acc * _U(_COMB) + hashes[k : k + m]
            whole = rows[:m] == rows[size - 1 :]
            out_rows, out = rows[:m][whole], mix(acc[whole])
        else:
            out_rows, out = np.zeros(0, np.int64), np.zeros(0, _U)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            first = np.searchsorted(rows, short)
            extra = counts[short].astype(_U)
            for k in range(size - 1):
                has = counts[short] > k
                at = np.minimum(first + k, len(hashes) - 1)
                extra = np.where(has, extra * _U(_COMB) + hashes[at], extra)
            out_rows = np.concatenate([out_rows, short])
            out = np.concatenate([out, mix(extra + _U(77))])
    return out_rows, out
