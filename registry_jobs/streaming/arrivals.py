"""Newly landed texts, readings and pages: narrow steps on a file stream, and cross-row steps batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from registry_jobs.operators import election as V
from registry_jobs.operators.corpus import correction_partials
from registry_jobs.operators.ownership import extract_fields
from registry_jobs.plans import jobs
from registry_jobs.sources.exports import has_enough_text

SCHEMA = "doc_id long, text string"
READINGS = "doc_id long, source string, raw_text string"
PAGES = "doc_id long, page_no int, source string, page_text string"
#: Hash buckets of documents: a batch rereads only those that its documents lie in.
BUCKETS = 64

Step = Callable[[DataFrame], DataFrame]


def gated_extract(docs: DataFrame) -> DataFrame:
    """(doc_id, fields) of texts with enough in them; stateless, so the same in batch and stream."""
    return extract_fields(docs.where(has_enough_text(F.col("text")))).select("doc_id", "fields")


def _started(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def _landed(spark: SparkSession, in_path: str, schema: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(in_path)


def stream_extract(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the records of files that land in in_path; a restart goes on from the checkpoint."""
    writer = gated_extract(_landed(spark, in_path, SCHEMA, None)).writeStream.format("parquet").option("path", out_path).outputMode("append")
    return _started(writer, checkpoint, available_now)


def dealt(batch: DataFrame) -> DataFrame:
    """The rows of a batch over all cores: a batch of few files would be read, and worked on, by as few tasks."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch if batch.rdd.getNumPartitions() >= cores else batch.repartition(2 * cores)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def dealt_by_bucket(batch: DataFrame, buckets: int) -> DataFrame:
    """The rows of a batch over all cores, each task with rows of one bucket: it writes one file, where rows dealt
    anyhow make one of each bucket in each task. Documents stay together, so what their readings share is near."""
    each = -(-2 * batch.sparkSession.sparkContext.defaultParallelism // buckets)  # tasks a bucket
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(each)).cast("int")
    return batch.repartitionById(buckets * each, bucket_of(buckets) * each + part)


def settle_batch(arrive: Step, settle: Step, out_path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step for results that need all rows of a document.

    arrive, a narrow step, is applied to what the batch brings and kept under arrived/batch=N/bucket=B. Then the
    documents of the batch, and only those, are settled anew from all that has arrived of them, into
    settled/batch=N. Both folders are named by the batch and overwritten, and nothing later than the batch
    is read, so a batch that is replayed after a failure leaves what it would have left at once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here = f"{out_path}/arrived/batch={batch_id}"
        arrive(dealt_by_bucket(batch, buckets)).withColumn("bucket", bucket_of(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(here)
        new = spark.read.parquet(here)
        if new.isEmpty():
            return
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        all_ = spark.read.schema(new.schema.add("batch", "long")).option("basePath", f"{out_path}/arrived").parquet(f"{out_path}/arrived")
        mine = all_.where((F.col("batch") <= batch_id) & F.col("bucket").isin(touched)).join(new.select("bucket", "doc_id").distinct(), ["bucket", "doc_id"], "left_semi")
        settle(mine.drop("bucket", "batch")).write.mode("overwrite").parquet(f"{out_path}/settled/batch={batch_id}")

    return step


def settled(spark: SparkSession, out_path: str) -> DataFrame:
    """What holds now: of each document the rows of the last batch that settled it."""
    rows = spark.read.parquet(f"{out_path}/settled")
    last = F.max("batch").over(Window.partitionBy("doc_id"))
    return rows.withColumn("last", last).where("batch = last").drop("batch", "last")


def _settled_stream(arrived: DataFrame, arrive: Step, settle: Step, out_path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    return _started(arrived.writeStream.foreachBatch(settle_batch(arrive, settle, out_path)), checkpoint, available_now)


def elect_again(candidates: DataFrame) -> DataFrame:
    return jobs.with_reasons(V.elect(V.gate_ocr(candidates)))


def stream_elect(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Readings that land in any order, elected anew for the documents they belong to; settled() has the records.

    A reading is normalised, scored and extracted once, when it arrives. After any batch the records are those
    of readings_to_record() over all readings so far.
    """
    return _settled_stream(_landed(spark, in_path, READINGS, files_per_batch), jobs.read_readings, elect_again, out_path, checkpoint, available_now)


def stream_assemble(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Pages that land in any order, assembled anew to (doc_id, source, text) for the documents they belong to."""
    pages = _landed(spark, in_path, PAGES, files_per_batch)
    return _settled_stream(pages, lambda df: df, lambda df: V.assemble_documents(df, ("doc_id", "source")), out_path, checkpoint, available_now)


def stream_corrections(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Mergeable corpus counts: each batch of texts leaves correction_partials() under batch=N, a replayed batch the same again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        found = jobs.normalized_with_report(dealt(batch)).select("doc_id", F.col("normal.corrections").alias("corrections"))
        correction_partials(found).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return _started(_landed(spark, in_path, SCHEMA, files_per_batch).writeStream.foreachBatch(step), checkpoint, available_now)
