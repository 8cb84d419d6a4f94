"""Centroid clustering: Lloyd's rounds in exact integers, sharded by dimension.

Vectors are cut into chunks of rows and each chunk into blocks of columns. A task that holds a column block
of a chunk computes its partial squared distances against its own slice of the centroids; partial distances
of a chunk are added by key, and the sum's smallest entry is the assignment. The assignment goes back to the
blocks, which sum their own columns by cluster, so each shard makes its own slice of the next centroids.
Nothing but slices (clusters x columns numbers) is ever broadcast, and nothing goes through the driver but
the start centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registry_jobs.llm.common import dropped, written
from registry_jobs.sources.tables import width

CLUSTERS = 40
ROUNDS = 5
DIM = 64
BLOCKS = 4
SCALE = 256
#: Rows of a chunk: a message of partial distances has ROWS x clusters longs.
ROWS = 1024
#: Components below this bound have squared distances that fit a long, in up to 64 dimensions.
MOST = 1 << 27
LABELS = "chunk long, labels binary, distances binary"


def quantized(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, q): vectors of exactly dim components, none null or non-finite, as floor(scale * x)."""
    x = F.transform(vector_col, lambda e: e.cast("double"))
    finite = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    far = F.raise_error(F.lit(f"a component is {MOST} or more after scaling: squared distances would pass 64 bits")).cast("long")
    q = F.transform(x, lambda e: F.when(F.abs(e * scale) < MOST, F.floor(e * scale)).otherwise(far))
    kept = df.where(F.coalesce(F.size(vector_col) == dim, F.lit(False)) & finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q"))


def start(vectors: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of `2:<vec_id>`; ties by their components, null ids last."""
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return [r["q"] for r in vectors.orderBy(order.asc_nulls_last(), "q").limit(clusters).select("q").collect()]


def _cut(dim: int, edges: list[int]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                x = part.column(2).flatten().to_numpy().reshape(-1, dim)
                ids = pa.ListArray.from_arrays(pa.array([0, len(part), *[len(part)] * (len(edges) - 2)], pa.int32()), part.column(1))
                blocks = [np.ascontiguousarray(x[:, a:b], "<i4").tobytes() for a, b in zip(edges, edges[1:])]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0)[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([b - a for a, b in zip(edges, edges[1:])], pa.int32()), ids, pa.array(blocks, pa.binary())],
                    names=["chunk", "block", "columns", "ids", "data"],
                )

    return cut


def column_blocks(vectors: DataFrame, dim: int, blocks: int) -> DataFrame:
    """(chunk, block, columns, ids, data), written: a row a chunk and column block, ids (of the rows) with the first block only."""
    edges = [dim * k // blocks for k in range(blocks + 1)]
    n = width(vectors.sparkSession)
    cut = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "q").mapInArrow(_cut(dim, edges), "chunk long, block int, columns int, ids array<long>, data binary")
    return written(cut.repartition(n, "block", F.pmod(F.xxhash64("chunk"), F.lit(max(1, n // blocks)))))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            columns = batch.column(1)[k].as_py()
            x = np.frombuffer(batch.column(2)[k].as_py(), "<i4").reshape(-1, columns).astype(np.int64)
            c = batch.column(3)[k].values.to_numpy().reshape(-1, columns)
            d = np.zeros((len(x), len(c)), np.int64)
            for j in range(columns):
                d += (x[:, j, None] - c[None, :, j]) ** 2
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([len(c)], pa.int32()), pa.array([d.tobytes()], pa.binary())], names=["chunk", "clusters", "part"])


def _nearest(group: pa.Table) -> pa.Table:
    clusters = group["clusters"][0].as_py()
    total = sum(np.frombuffer(p.as_py(), np.int64) for p in group["part"]).reshape(-1, clusters)
    label = total.argmin(axis=1)  # of equal ones the first
    least = total[np.arange(len(total)), label]
    return pa.table({"chunk": group["chunk"].slice(0, 1), "labels": pa.array([label.astype("<i4").tobytes()], pa.binary()), "distances": pa.array([least.tobytes()], pa.binary())})


def assigned(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """(chunk, labels, distances), written: partial distances of the column blocks, added by chunk, and the nearest centroid."""
    whole = slices.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "values"))), lambda s: s["values"])).alias("slice"))
    met = blocks.join(F.broadcast(whole), "block").select("chunk", "columns", "data", "slice")  # clusters x dim longs in all
    return written(met.mapInArrow(_partial, "chunk long, clusters int, part binary").groupBy("chunk").applyInArrow(_nearest, LABELS))


def _sums(clusters: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                block, columns = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                x = np.frombuffer(batch.column(2)[k].as_py(), "<i4").reshape(-1, columns)
                label = np.frombuffer(batch.column(3)[k].as_py(), "<i4")
                total, n = held.setdefault(block, (np.zeros((clusters, columns), np.int64), np.zeros(clusters, np.int64)))
                np.add.at(total, label, x)
                n += np.bincount(label, minlength=clusters)
        for block, (total, n) in held.items():
            cluster, column = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cluster), block), pa.int32()), pa.array(cluster, pa.int32()), pa.array(column, pa.int32()), pa.array(total[cluster, column]), pa.array(n[cluster])],
                names=["block", "cluster", "column", "total", "n"],
            )

    return sums


def updated(blocks: DataFrame, slices: DataFrame, labels: DataFrame, clusters: int) -> DataFrame:
    """The slices (block, cluster, values) after a round, written: each shard's exact means, rounded down; empty clusters keep theirs."""
    met = blocks.join(labels.select("chunk", "labels").hint("merge"), "chunk").select("block", "columns", "data", "labels")
    sums = met.mapInArrow(_sums(clusters), "block int, cluster int, column int, total long, n long")
    mean = sums.groupBy("block", "cluster", "column").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = mean.withColumn("mean", F.expr("(total - pmod(total, n)) div n"))
    new = mean.groupBy("block", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "mean"))), lambda s: s["mean"]).alias("new"))
    return written(slices.join(new, ["block", "cluster"], "left").select("block", "cluster", F.coalesce("new", "values").alias("values")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            label, far = (np.frombuffer(batch.column(j)[k].as_py(), kind) for j, kind in ((1, "<i4"), (2, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(label), pa.array(far)], names=["vec_id", "cluster", "distance"])


def centroid_hash(values: Column) -> Column:
    return F.sha2(F.array_join(F.transform(values, lambda v: v.cast("string")), ","), 256)


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, blocks: int = BLOCKS, scale: int = SCALE
) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance), a row a vector, and centroids (cluster, values), both written.

    Vectors that are null, have another length than dim, or null or non-finite components have no row. Repeated
    rows and repeated or null ids are vectors of their own; start centroids with equal hashes go by their
    components, null ids come last. Of equally near centroids the smaller number wins. With fewer vectors than
    clusters each is a centroid; an empty table gives empty results. Columns besides the two named are not
    read. A component of 2^27 or more after scaling is an error, as its distances fit no long.
    """
    spark = df.sparkSession
    vectors = quantized(df, id_col, vector_col, dim, scale)
    seeds = start(vectors, clusters)
    held = column_blocks(vectors, dim, blocks)
    edges = [dim * k // blocks for k in range(blocks + 1)]
    slices = spark.createDataFrame([(b, c, row[edges[b] : edges[b + 1]]) for c, row in enumerate(seeds) for b in range(blocks)], "block int, cluster int, values array<long>")
    old = None
    for _ in range(rounds):
        labels = assigned(held, slices)
        slices = updated(held, slices, labels, len(seeds))
        dropped(labels, *([old] if old is not None else []))
        old = slices
    labels = assigned(held, slices)
    ids = held.where("block = 0").select("chunk", "ids")
    rows = written(ids.join(labels.hint("merge"), "chunk").select("ids", "labels", "distances").mapInArrow(_rows, "vec_id long, cluster int, distance long"))
    whole = slices.groupBy("cluster").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "values"))), lambda s: s["values"])).alias("values"))
    centroids = written(whole)
    dropped(labels, held, *([old] if old is not None else []))
    return rows, centroids


def cluster_digest(df: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: cluster() with the sums of its distances."""
    rows, centroids = cluster(df, **settings)
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = F.sum("cluster_inertia").over(Window.partitionBy())  # over a row a cluster
    known = sums.join(centroids.select("cluster", centroid_hash(F.col("values")).alias("centroid_sha256")), "cluster").withColumn("inertia", total)
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster
