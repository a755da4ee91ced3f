"""Incremental ingest of a growing source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldtrace import fixed
from fieldtrace.functions import text as tx
from fieldtrace.plans import ingest as job
from fieldtrace.sources.files import _plain_path
from fieldtrace.sources.store import Store

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(
    spark: SparkSession,
    path: str,
    extensions: list[str] | None = None,
    exclude: list[str] | None = None,
    files_per_batch: int = fixed.FILES_PER_BATCH,
) -> DataFrame:
    """New files under a folder as `(file_path, content)` texts."""
    names = ",".join(e.lstrip(".") for e in extensions or fixed.EXTENSIONS)
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + names + "}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .select(_plain_path("path").alias("file_path"), "content")
    )
    return files.where(~tx.excluded("file_path", exclude or [])).select(
        "file_path", tx.lenient_utf8("content").alias("content")
    )


def ingest_stream(
    sources: DataFrame,
    store: Store,
    embed: job.Embed,
    checkpoint: str,
    mode: str = "skip",
    with_mappings: bool = False,
) -> StreamingQuery:
    """Puts a stream of sources into the store; stops when nothing new is there.

    Started again with the same checkpoint it goes on where it stopped. A micro-batch that runs
    twice adds nothing the second time, as ids in the store are not put in again.
    """
    first = store.next_batch()

    def put(batch: DataFrame, number: int) -> None:
        # Read by the look-up of stored ids and by the write.
        batch.persist()
        try:
            job.ingest(store, batch, embed, mode, with_mappings, first + number)
        finally:
            batch.unpersist()

    return (
        sources.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_progress(store: Store, total: int | None = None) -> DataFrame:
    """Per micro-batch: files and records it stored, files stored so far, percent of `total`.

    The running count goes over one row per micro-batch.
    """
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.col("processed")
    return (
        store.code()
        .groupBy("batch_id")
        .agg(F.count_distinct("file_path").alias("n_files"), F.count("*").alias("n_records"))
        .withColumn("processed", F.sum("n_files").over(so_far))
        .withColumn("percent", F.round(done / F.lit(total) * 100, 1))
    )
