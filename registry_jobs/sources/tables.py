"""Reading tables so that the work on them is dealt over all cores, and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def width(spark: SparkSession) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df as it is where it has as many files as there are cores; else its rows dealt over all cores.

    A file of one row group is read by one task, however many cores wait for its rows, and Spark's splits of it
    don't tell. Large tables have more files than a cluster has cores, so they aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(2 * cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def many_folders(spark: SparkSession) -> Iterator[None]:
    """While a table of very many folders is opened: they are listed by a few tasks a core, where Spark takes a task for each folder, up to 10,000."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. One of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one: all scratch tables lie in it."""
    return f"{scratch_dir(spark)}/run-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application: for the end of a job, when its results are written elsewhere."""
    _delete(spark, run_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and later plans know its size."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables made by written() which no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)
