"""A file a document in a folder that all machines see as their own (scheme file): written, placed, listed and read by tasks.

Spark's writer and its index take many milliseconds for each file, most of them one after another in the driver. Other stores, and
folders with anything that only Spark's reader knows (compressed files, other partitions), stay with Spark: the functions return None or False.
"""

from __future__ import annotations

import os
import re
import shutil
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry_jobs.sources.tables import dropped, width, written

Batches = Iterator[pa.RecordBatch]
COMPRESSED = r"\.(?:gz|bz2|deflate|snappy|lz4|zst|zstd|passthrough|lzo|xz)\z"
_READ_BYTES = 1 << 23  # of texts in one batch
_PLAIN = re.compile(r"[A-Za-z0-9_\-!.~'()*,;:$&+=/@]*").fullmatch


def own_path(spark: SparkSession, path: str) -> str | None:
    """path as the machines' own files have it; None where it lies in another store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _folder_name(doc_id: str | None) -> str:
    """The name Spark gives a partition of this value."""
    if not doc_id:
        return "doc_id=__HIVE_DEFAULT_PARTITION__"
    return "doc_id=" + re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", doc_id)


def _to_files(folder: str, run: str) -> Callable[[Batches], Batches]:
    def write(batches: Batches) -> Batches:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{run}.c000.txt"
        hidden = f".{task.taskAttemptId()}.{name}"  # an attempt that fails, or one beside it, leaves nothing that is read
        last, out = None, None
        for batch in batches:
            made = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = _folder_name(doc_id)
                if at != last:
                    if out is not None:
                        out.close()
                    os.makedirs(f"{folder}/{at}", exist_ok=True)
                    last, out = at, open(f"{folder}/{at}/{hidden}", "wb")
                    made.append(at)
                out.write((value or b"") + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array([hidden] * len(made), pa.string())], ["at", "hidden"])
        if out is not None:
            out.close()

    return write


def _into_place(folder: str) -> Callable[[Batches], Batches]:
    def place(batches: Batches) -> Batches:
        for batch in batches:
            for at, hidden in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here, name = f"{folder}/{at}", hidden.split(".", 2)[2]
                try:
                    os.replace(f"{here}/{hidden}", f"{here}/{name}")
                except FileNotFoundError:  # placed by an earlier attempt
                    if not os.path.exists(f"{here}/{name}"):
                        raise
                for other in os.scandir(here):
                    if other.name != name:
                        shutil.rmtree(other.path) if other.is_dir(follow_symlinks=False) else os.remove(other.path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return place


def write_documents(texts: DataFrame, path: str) -> bool:
    """(doc_id, value) as doc_id=N/part-..., one file each: False where the folder isn't the machines' own.

    Files are written hidden; only when all are there do they take the place of what the folders of these documents held.
    """
    spark = texts.sparkSession
    folder = own_path(spark, path)
    if folder is None:
        return False
    os.makedirs(folder, exist_ok=True)
    rows = texts.select(F.nullif(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("value").cast("binary"))
    dealt = rows.repartition(width(spark), "doc_id").sortWithinPartitions("doc_id")  # all of a folder in one task
    made = written(dealt.mapInArrow(_to_files(folder, str(uuid.uuid4())), "at string, hidden string"))
    made.mapInArrow(_into_place(folder), "n long").agg(F.sum("n")).collect()
    dropped(made)
    open(f"{folder}/_SUCCESS", "wb").close()
    return True


def _ignored(name: str) -> bool:
    """What Spark's index leaves out."""
    out = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _below(path: str) -> Iterator[str]:
    if not os.path.isdir(path):
        yield path
        return
    for x in os.scandir(path):
        if not _ignored(x.name):
            if x.is_dir():
                yield from _below(x.path)
            else:
                yield x.path


def _levels(folder: str, enough: int) -> int:
    """Levels of folders to pass before there is enough to deal out; no more than that is looked at."""
    at, depth = [folder], 0
    while True:
        found = list(islice((x for d in at for x in os.scandir(d) if not _ignored(x.name)), enough))
        at = [x.path for x in found if x.is_dir()]
        if len(found) >= enough or not at:
            return depth
        depth += 1


def _dealt(folder: str, depth: int, mine: Callable[[str], bool]) -> Iterator[str]:
    """The files below the entries at the given level, and of the files above, that are this task's."""
    for x in os.scandir(folder):
        if not _ignored(x.name):
            if depth and x.is_dir():
                yield from _dealt(x.path, depth - 1, mine)
            elif mine(x.path):
                yield from _below(x.path)


def _walked(folder: str, depth: int, tasks: int) -> Callable[[Batches], Batches]:
    def walk(batches: Batches) -> Batches:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                paths = _dealt(folder, depth, lambda p: zlib.crc32(p.encode("utf-8", "surrogateescape")) % tasks == k)  # noqa: B023
                while some := list(islice(paths, 5000)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["path"])

    return walk


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files under a folder: each task looks through the upper folders and keeps its share of what is in them, so no
    name passes through the driver."""
    tasks = spark.sparkContext.defaultParallelism
    depth = _levels(folder, 8 * tasks)
    return written(spark.range(0, tasks, 1, tasks).mapInArrow(_walked(folder, depth, tasks), "path string"))


def _contents(batches: Batches) -> Batches:
    def made(paths: list[str], texts: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(paths, pa.string()), pa.array(map(file_uri, paths), pa.string()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["path", "uri", "content"])

    paths, texts, size = [], [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as f:
                text = f.read()
            if not text:
                continue  # Spark has no row for a file without a byte
            paths.append(path)
            texts.append(text)
            size += len(text)
            if size > _READ_BYTES or len(paths) >= 5000:
                yield made(paths, texts)
                paths, texts, size = [], [], 0
    if paths:
        yield made(paths, texts)


def read_files(spark: SparkSession, path: str, below: str | None = None) -> DataFrame | None:
    """(path, uri, value): each file under a folder as one text, its bytes as they are. None where Spark's reader must do it.

    below: a pattern that the paths under the folder must all match.
    """
    folder = own_path(spark, path)
    if folder is None or not os.path.isdir(folder):
        return None
    files = _listed(spark, folder.rstrip("/"))
    odd = F.col("path").rlike(COMPRESSED)
    if below is not None:
        odd = odd | ~F.substring("path", len(folder.rstrip("/")) + 2, 1 << 20).rlike(below)
    if not files.where(odd).isEmpty():
        dropped(files)
        return None
    return files.mapInArrow(_contents, "path string, uri string, content binary").select("path", "uri", F.col("content").cast("string").alias("value"))


def file_uri(path: str) -> str:
    """The URI that Spark's _metadata.file_path shows for a path."""
    if _PLAIN(path):
        return "file:" + path

    def one(c: str) -> str:
        kept = c.isalnum() or c in "_-!.~'()*,;:$&+=/@" if c.isascii() else unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp")
        return c if kept else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogateescape"))

    return "file:" + "".join(map(one, path))
