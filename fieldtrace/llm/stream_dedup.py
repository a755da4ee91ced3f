"""Exact duplicates by a stream with keyed state that never expires.

The stream reads the files of a table in micro-batches. Its state, in RocksDB on the executors' disks with
its log in the shared folder, holds for each digest of a normalised text how many rows have it, and of
the row that stays the identifier and the content's locator (file and row number). State is partitioned
by digest; rows of a batch are folded before the shuffle, so a frequent text is one row per task. When
all files are in, the state is read as a table; rows that hit an entry are compared with the content at
its locator, byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrace.llm.common import SPACE_BYTES, new_folder, written
from fieldtrace.session import small

BATCH_BYTES = 16 << 30  # of files read in one micro-batch
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # All state of an executor together; what is no longer used goes soon.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def normalised(text: Column) -> Column:
    """The text without white space; null as empty."""
    text = F.coalesce(text, F.lit(""))
    for byte in SPACE_BYTES:
        text = F.replace(text, F.lit(chr(byte)), F.lit(""))
    return text


def _digest(text: Column, bits: int) -> Column:
    return F.substring(F.unhex(F.sha2(F.encode(text, "utf-8"), 256)), 1, bits // 8)


def _facts(rows: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    plain = normalised(F.col(f"`{text_col}`"))
    return rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.char_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("chars"),
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        ).alias("at"),
        plain.alias("plain"),
        _digest(plain, bits).alias("digest"),
    )


def _files(spark: SparkSession, path: str, batch_bytes: int) -> DataFrame:
    """A stream of a Parquet folder, or of a single file."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes)
    if system.getFileStatus(where).isFile():
        reader = reader.option("pathGlobFilter", where.getName())
        path = where.getParent().toString()
    return reader.parquet(path)


def fold_stream(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
    bits: int = 256,
) -> DataFrame:
    """Takes all files at `path` that the checkpoint has not seen into its state, and returns the state.

    One row per digest: digest, n, chars, id and at (file, row) of the row that stays so far.
    """
    facts = _facts(_files(spark, path, batch_bytes), id_col, text_col, bits).drop("plain")
    # Most code points, then the smallest id; a null id is after all others.
    best = F.max(F.struct("chars", (-F.col("id")).alias("order"), "at"))
    folded = facts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    with _settings(spark, STATE):
        running = (
            folded.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        count, best = (f.name for f in state.schema["value"].dataType.fields)
        state = state.select(
            F.col("key.digest").alias("digest"),
            F.col(f"value.`{count}`").alias("n"),
            F.col(f"value.`{best}`.chars").alias("chars"),
            (-F.col(f"value.`{best}`.order")).alias("id"),
            F.col(f"value.`{best}`.at").alias("at"),
        )
        return written(state, "dedup-state")


def _strangers(facts: DataFrame, state: DataFrame) -> DataFrame:
    """Rows whose text is not that of their digest's entry: at, digest, plain."""
    shared = written(state.where(F.col("n") > 1).select("digest", F.col("at").alias("kept")), "shared")
    hits = facts.select("digest", "at", "plain").join(small(shared), "digest")
    entries = hits.where(F.col("at") == F.col("kept")).select("digest", F.col("plain").alias("entry"))
    others = hits.where(F.col("at") != F.col("kept"))
    return others.join(entries, "digest").where(F.col("plain") != F.col("entry"))


def deduplicate(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
    bits: int = 256,
    checkpoint: str | None = None,
) -> DataFrame:
    """One row per row of the Parquet table at `path`: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without white space; null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest id, then the last by file and row; null ids come
    after all others and give a null keep_id. Rows are told apart by file and row number, so rows that
    repeat an id, or everything, are duplicates of each other as any others; one of them is kept.
    An empty table gives no rows; columns other than the two are not read. `bits` of the SHA-256 digest
    key the state. Where texts share those, the byte comparison parts them and they are grouped by
    their full text.
    """
    checkpoint = checkpoint or new_folder(spark, "dedup-stream")
    state = fold_stream(spark, path, checkpoint, id_col, text_col, batch_bytes, bits)
    facts = _facts(spark.read.parquet(path), id_col, text_col, bits)
    odd = written(_strangers(facts, state).select("at", "digest"), "strangers")
    named = state.select("digest", "n", F.col("id").alias("keep_id"), F.col("at").alias("kept_at"))
    rows = facts.withColumn("sha256", F.lower(F.hex(_digest(F.col("plain"), 256))))
    if not odd.isEmpty():
        rows, named = _parted(rows, odd, named)
    narrow = rows.select("id", "at", "digest", "sha256")
    return narrow.join(named, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("at") == F.col("kept_at")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def _parted(rows: DataFrame, odd: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of digests that several texts share, grouped by the text itself."""
    mixed = odd.select("digest").distinct()
    exact = rows.join(mixed, "digest", "left_semi").withColumn(
        "digest", F.concat(F.col("digest"), F.encode("plain", "utf-8"))
    )
    best = F.max(F.struct("chars", (-F.col("id")).alias("order"), "at")).alias("best")
    groups = exact.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best)
    groups = groups.select(
        "digest", "n", (-F.col("best.order")).alias("keep_id"), F.col("best.at").alias("kept_at")
    )
    rows = rows.join(mixed, "digest", "left_anti").unionByName(exact)
    return rows, named.join(mixed, "digest", "left_anti").unionByName(groups)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


SQL = r"""
with facts as (
  select doc_id, length(coalesce(text, '')) as chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as plain from documents),
ranked as (
  select *, first_value(doc_id) over (partition by plain order by chars desc, doc_id) as keep_id,
         count(*) over (partition by plain) as group_size from facts)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(plain) as text_sha256 from ranked"""
