"""Near-duplicate detection by BagMinHash signatures, banding, and verified multiset overlap.

A document is the multiset of its five-word shingles. A shingle of weight w owns the Poisson processes
of the discretised weight levels [0,1), [1,2), [2,4), [4,8) ...; the process of a level interval has the
interval's length as its rate, and of the last one only points under w count. Every point has a time, a
slot of the signature and an identity; a slot's value is its earliest point. Two documents share what
lies under both weights, so a slot agrees with the probability of their weighted Jaccard similarity.
Points after the time by which all slots have surely been met are never made, so that a long document
costs little more than one hash a shingle.

Signatures are cut into bands; documents that agree in a band are candidates, and every candidate pair
that is used is verified on its texts. Equal texts are one representative before any of this.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registry_jobs.llm.common import dropped, join_counted, keep_rows, mix, shingles, text_or_empty, text_slices, written

_U = np.uint64
WORDS = 5
SIMILARITY = 0.8
SLOTS = 200
BANDS = 56
ROWS = 9
LEAST_AGREEMENT = 0.64  # of slots; similarity 0.8 agrees in fewer with a probability below 1e-7
SLICE = 1 << 18  # bytes of texts that are signed at once: short texts have many points a shingle
DEAL = 1000  # rows of one shingle that meet in one task


def weigh(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted, with counts."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def bag_minhash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """(n_rows, slots) identities of each slot's earliest point; 0 in rows without elements."""
    out = np.zeros((n_rows, slots), _U)
    todo = np.unique(rows)
    factor = math.log(slots) + 3
    while len(todo):
        earliest, winner = _earliest(rows, hashes, weights, n_rows, slots, factor)
        full = np.isfinite(earliest).all(axis=1)
        ready = todo[full[todo]]
        out[ready] = winner[ready]
        todo = todo[~full[todo]]
        keep = np.isin(rows, todo)
        rows, hashes, weights = rows[keep], hashes[keep], weights[keep]
        factor *= 2
    return out


def _earliest(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, slots: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        total = np.bincount(rows, weights=weights, minlength=n_rows)
        until = slots * factor / np.maximum(total, 1)
        row, seed, low, weight = [rows], [mix(hashes ^ _U(0xA5A5))], [np.zeros(len(rows))], [weights]
        level = 1
        more = weights > 1
        while more.any():  # [level, 2 * level)
            row.append(rows[more])
            seed.append(mix(hashes[more] + _U(level) * _U(0x9E3779B97F4A7C15)))
            low.append(np.full(int(more.sum()), float(level)))
            weight.append(weights[more])
            level *= 2
            more = weights > level
        row, seed, low, weight = map(np.concatenate, (row, seed, low, weight))
        rate = np.maximum(low, 1.0)
        time, k, width = np.zeros(len(row)), np.zeros(len(row), _U), 1
        earliest = np.full(n_rows * slots, np.inf)
        keys, times, names = [], [], []
        while len(row):
            step = k[:, None] + np.arange(1, width + 1, dtype=_U)
            point = mix(seed[:, None] + step * _U(0xBF58476D1CE4E5B9))
            gap = -np.log1p(-((point >> _U(11)).astype(np.float64) * 2.0**-53)) / rate[:, None]
            gap[:, 0] += time
            at = np.cumsum(gap, axis=1)
            name = mix(point ^ _U(0x5851F42D4C957F2D))
            inside = at <= until[row][:, None]
            counts = inside & (low[:, None] + (mix(name) >> _U(11)).astype(np.float64) * 2.0**-53 * rate[:, None] < weight[:, None])
            if counts.any():
                owner = np.broadcast_to(row[:, None], counts.shape)[counts]
                keys.append(owner * slots + (name[counts] % _U(slots)).astype(np.int64))
                times.append(at[counts])
                names.append(name[counts])
            on = inside[:, -1]
            row, seed, low, weight, rate, time, k = row[on], seed[on], low[on], weight[on], rate[on], at[on, -1], k[on] + _U(width)
            width = min(64, width * 4)
        winner = np.zeros(n_rows * slots, _U)
        if keys:
            key, at, name = np.concatenate(keys), np.concatenate(times), np.concatenate(names)
            np.minimum.at(earliest, key, at)
            first = at == earliest[key]
            np.maximum.at(winner, key[first], name[first])
    return earliest.reshape(n_rows, slots), winner.reshape(n_rows, slots)


def band_slots(slots: int, bands: int, rows: int) -> np.ndarray:
    """(bands, rows) slots of each band: fixed choices, which may share slots with other bands."""
    r = np.random.default_rng(20)
    return np.stack([np.sort(r.choice(slots, rows, replace=False)) for _ in range(bands)])


def band_keys(signature: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(n, bands) keys: equal where all slots of the band agree."""
    with np.errstate(over="ignore"):
        acc = np.zeros((len(signature), len(chosen)), _U) + np.arange(1, len(chosen) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
        for r in range(chosen.shape[1]):
            acc = mix(acc + signature[:, chosen[:, r]])
    return acc


def _sign(size: int, slots: int, bands: int, rows: int):
    chosen = band_slots(slots, bands, rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2), SLICE):
                n = len(offsets) - 1
                got = weigh(*shingles(data, offsets, size))
                signature = bag_minhash(*got, n, slots)
                has = np.bincount(got[0], minlength=n) > 0
                ends = np.concatenate(([0], np.cumsum(has * bands)))
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_keys(signature[has], chosen).reshape(-1).view(np.int64)))
                low = signature.astype(np.uint8)
                sketch = pa.array([row.tobytes() for row in low], pa.binary())
                weight = np.bincount(got[0], weights=got[2], minlength=n)
                spread = np.bincount(got[0], minlength=n) / np.maximum(weight, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), keys, sketch, pa.array(weight.astype(np.int64)), pa.array(spread)],
                    names=["doc_id", "key", "bands", "sketch", "weight", "spread"],
                )

    return sign


def _likely(least: float):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
            kept = batch.filter(pa.array((x == y).mean(axis=1) >= least))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return likely


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - shared
    return shared / whole if whole else 0.0


def _verify(size: int, similarity: float):
    def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, data, offsets in text_slices(column):
            n = len(offsets) - 1
            rows, hashes, counts = weigh(*shingles(data, offsets, size))
            cut = np.searchsorted(rows, np.arange(n + 1))
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                yield hashes[x:y], counts[x:y]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [overlap(x, y) >= similarity - 1e-12 for x, y in zip(bags(batch.column(2)), bags(batch.column(3)), strict=True)]
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return verify


def _bags(size: int):
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                rows, hashes, counts = weigh(*shingles(data, offsets, size))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + rows)), pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], names=["rid", "h", "w"])

    return bags


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting: both sides grow with the corpus, so neither is ever broadcast."""
    return left.join(right.hint("merge"), on, how)


def prefix_pairs(placed: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Pairs (a, b) among placed (rid, root, weight), of different roots, that may have the similarity, as a written table.

    Shingles are ordered by how many of these texts hold them, rare ones first. A text's prefix are the
    shingles from which on, in this order, at least `similarity` of its weight lies; two texts of the
    similarity share the first of their common shingles, and both prefixes hold it. So no pair is lost,
    and texts that only share what is common do not meet. The rows of a frequent shingle are dealt out,
    DEAL to a task, and those that look for partners among them go to each part.
    """
    bag = written(merged(texts, placed.select("rid"), "rid").select("rid", "text").mapInArrow(_bags(size), "rid long, h long, w long"))
    # shingles of one text only come first and are no text's meeting point: they are left out
    often = bag.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = Window.partitionBy("rid")
    upto = F.sum("w").over(mine.orderBy("df", "h").rowsBetween(Window.unboundedPreceding, 0))
    ordered = merged(merged(bag, often, "h").withColumn("rest", F.sum("w").over(mine) - upto + F.col("w")), placed, "rid")
    prefix = written(ordered.where(F.col("rest") >= F.col("weight") * F.lit(similarity - 1e-9)).select("h", "rid", "root", "weight", "rest"))
    # members of a shingle's largest component meet the others, not each other
    by_root = prefix.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = by_root.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("times"))
    largest = written(largest.where("roots > 1").select("h", "largest", "times"))
    known = join_counted(prefix, largest, ["h"], prefix.count())
    parts = F.floor((F.col("times") - 1) / DEAL).cast("int") + 1
    x = known.where("root != largest").select("h", F.col("rid").alias("a"), F.col("root").alias("ra"), F.col("weight").alias("wa"), F.col("rest").alias("sa"), "largest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    y = known.select("h", F.col("rid").alias("b"), F.col("root").alias("rb"), F.col("weight").alias("wb"), F.col("rest").alias("sb"), F.pmod(F.xxhash64("rid"), parts).cast("int").alias("part"))
    # what lies from the shingle on must hold all that they need to share
    enough = F.least("sa", "sb") >= (F.col("wa") + F.col("wb")) * F.lit(similarity / (1 + similarity) - 1e-9)
    once = (F.col("rb") == F.col("largest")) | (F.col("a") < F.col("b"))
    met = merged(x, y, ["h", "part"]).where((F.col("ra") != F.col("rb")) & once & enough & alike(F.col("wa"), F.col("wb"), similarity))
    pairs = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    dropped(bag, prefix, largest)
    return pairs


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Weights that texts of the similarity may have."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity - 1e-9)


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rids whose texts have the similarity, as a written table.

    Signatures, eight bits a slot, come first: only pairs that agree in enough slots meet their texts.
    """
    x = reps.select(F.col("rid").alias("a"), F.col("sketch").alias("sketch_a"))
    y = reps.select(F.col("rid").alias("b"), F.col("sketch").alias("sketch_b"))
    signed = merged(merged(pairs, x, "a"), y, "b").select("a", "b", "sketch_a", "sketch_b")
    likely = written(signed.mapInArrow(_likely(LEAST_AGREEMENT), "a long, b long"))
    x = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    y = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    both = merged(merged(likely, x, "a"), y, "b").select("a", "b", "text_a", "text_b")
    links = written(both.mapInArrow(_verify(size, similarity), "a long, b long").distinct())
    dropped(likely)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node with an edge.

    Large-star and small-star steps by joins and minima; no task gathers the neighbours of a node.
    Each round is written to the shared folder, and rounds grow with the logarithm of a component's size.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = merged(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        dropped(now)
        now = after
        if state == seen:
            break
        seen = state
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._scratch_path = now._scratch_path
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, slots: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """ids (row_id, doc_id, key), one a row of docs, and labels (key, class_id, links, keeps, keep_row, times), one a text, both written."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    ids = written(base.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "key"))
    signed = base.select("doc_id", "key", "text").mapInArrow(_sign(size, slots, bands, rows), "doc_id long, key binary, bands array<long>, sketch binary, weight long, spread double")
    reps = signed.groupBy("key").agg(F.min("doc_id").alias("rep_id"), *[F.first(c).alias(c) for c in ("bands", "sketch", "weight", "spread")])
    reps = written(reps.withColumn("rid", F.monotonically_increasing_id()))  # fixed by being written
    banded = reps.where(F.size("bands") > 0).select("rid", "weight", "spread", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("spread", "rid", "weight")).alias("leader")).where("times > 1")
    members = banded.select("bucket", "rid", "weight")
    members = join_counted(members, shared.select("bucket", "times", F.col("leader.rid").alias("leader"), F.col("leader.weight").alias("leader_weight")), ["bucket"], reps.count() * bands)
    members = written(members.drop("times"))

    # texts of candidates only, one row of each: grouped as they were joined
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("name")
    wanted = merged(members.select("rid").distinct(), reps.select("key", name("rep_id"), "rid"), "rid")
    met = merged(base.select("key", name("doc_id"), "text"), wanted, ["key", "name"])
    texts = written(met.groupBy("key", "name").agg(F.first("rid").alias("rid"), F.first("text").alias("text")).select("rid", "text"))

    star = members.where((F.col("rid") != F.col("leader")) & alike(F.col("weight"), F.col("leader_weight"), similarity))
    tried = written(star.select(F.least("leader", "rid").alias("a"), F.greatest("leader", "rid").alias("b")).distinct())
    links = verified(tried, reps, texts, size, similarity)
    roots = components(links)

    # texts of buckets that hold several components
    placed = merged(members, roots.select(F.col("node").alias("rid"), "root"), "rid", "left").select("bucket", "rid", "weight", F.coalesce("root", "rid").alias("root"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("times")).where("r0 != r1").select("bucket", "times")
    left = written(join_counted(placed, several, ["bucket"], members.count()).select("rid", "root", "weight").distinct())
    pairs = prefix_pairs(left, texts, size, similarity)
    found = verified(merged(pairs, tried, ["a", "b"], "left_anti"), reps, texts, size, similarity)
    done = [members, texts, tried, left, pairs, found, links]
    if not found.isEmpty():
        links = written(links.unionByName(found))
        done += [links, roots]
        roots = components(links)

    node = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    lowest = merged(node.select(F.col("node").alias("rid"), "root"), reps.select("key", "rid", "rep_id"), "rid")
    # no id is behind all ids; of two texts with the id of the class the one with the smaller key stays
    first = F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "key"))
    classes = lowest.groupBy("root").agg(first.alias("first")).select("root", F.col("first.rep_id").alias("class_id"), F.col("first.key").alias("keep_key"))
    degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("rid")).agg(F.count(F.lit(1)).alias("links"))
    copies = ids.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first"))
    inside = merged(merged(lowest.select("rid", "root"), classes, "root"), degree, "rid")
    labels = merged(merged(reps.select("key", "rid", "rep_id"), inside, "rid", "left"), copies.select("key", "times", F.col("first.row_id").alias("keep_row")), "key")
    alone = F.col("root").isNull()
    labels = written(
        labels.select(
            "key",
            F.when(alone, F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("links", F.lit(0)).cast("long").alias("links"),
            (alone | (F.col("key") == F.col("keep_key"))).alias("keeps"),
            "keep_row",
            "times",
        )
    )
    dropped(reps, roots, *done)
    return ids, labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY, slots: int = SLOTS, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, kept, links, key.

    class_id: the smallest id in the connected component of verified links (weighted Jaccard similarity
    of `size`-word shingles, words parted by white space, of at least `similarity`); links: verified
    links to other texts; key: MD5 of the text. One row of each class is kept, one with class_id.
    A text of fewer words than `size` is one shingle; texts without words, null included, are similar
    to equal texts only. Null ids come last: a class without any id has no class_id, and one of its rows is
    kept. Of rows repeated with id and text one is kept. An empty table gives an empty result; columns
    besides id and text are not read. A text of any length is one row.

    With 56 bands of 9 out of 200 slots a pair of similarity 0.8 meets in some bucket with probability
    0.999, one of 0.85 with 0.99999. First, all members of a bucket are compared with one of them, that
    with the fewest distinct shingles for its weight; then the texts of all buckets that hold several
    components of these links meet by prefix_pairs(), which loses none. Texts of other weights than the
    similarity allows are not compared. Shingles are known by 64-bit hashes.
    """
    ids, labels = _classes(docs, id_col, text_col, size, similarity, slots, bands, rows)
    out = join_counted(ids, labels, ["key"], ids.count())
    return out.select("doc_id", "class_id", (F.col("keeps") & (F.col("row_id") == F.col("keep_row"))).alias("kept"), "links", F.hex("key").alias("key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY, slots: int = SLOTS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with their own columns, whatever their names.

    Of rows equal in id and text the one stays whose other columns come first as JSON text.
    """
    ids, labels = _classes(docs, id_col, text_col, size, similarity, slots, bands, rows)
    n_rows = ids.count()
    more = labels.where("times > 1 or not keeps").select("key", F.col("class_id").alias("keep_id"), "keeps", "times")
    same = join_counted(ids, more, ["key"], n_rows).groupBy("key").agg(F.count(F.when(F.col("doc_id").eqNullSafe(F.col("keep_id")), 1)).alias("same"))
    stays = written(merged(more, same, "key"))
    dropped(ids, labels)
    return keep_rows(docs, id_col, text_col, F.unhex(F.md5(text_or_empty(text_col))), stays, n_rows)
