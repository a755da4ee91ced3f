"""Ingest by keyed state: what is known of each file lives in the stream, so a micro-batch costs what it brings.

The state of a file is the digest of its content. A file that comes again is unchanged, changed, or, with
null content, deleted; only what differs goes on to the store, which is appended to without being read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldtrace.functions import text as tx
from fieldtrace.operators import chunking
from fieldtrace.operators.embedding import embedded_only
from fieldtrace.plans import entries as en, lineage
from fieldtrace.plans.ingest import Embed
from fieldtrace.session import hold
from fieldtrace.sources import store as st
from fieldtrace.streaming.gathering import keyed_state

CHANGED = "file_path string, content string, change string"
NEW, OTHER, GONE = "new", "changed", "deleted"


class Changes(StatefulProcessor):
    """Per file the digest of what was passed on last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for batch in rows:  # of several versions in one micro-batch the latest holds
            for version, digest, content in zip(batch["version"], batch["digest"], batch["content"], strict=True):
                found = (version, digest or "", content)
                last = found if last is None or found[:2] >= last[:2] else last
        _, digest, content = last
        before = self.known.get()[0] if self.known.exists() else None
        if not digest:
            if before is None:
                return
            self.known.clear()
            change = GONE
        elif digest == before:
            return
        else:
            self.known.update((digest,))
            change = NEW if before is None else OTHER
        yield pd.DataFrame({"file_path": [key[0]], "content": [content], "change": [change]})

    def close(self) -> None:
        pass


def file_changes(sources: DataFrame, version_col: str | None = None) -> DataFrame:
    """A stream of `(file_path, content)` to `(file_path, content, change)`: new, changed or deleted.

    Null content deletes a file. Files whose content is as before have no row, nor have deletes of unknown
    files. Of several versions in a micro-batch the one with the greatest `version_col` (a number) holds.
    Rows without a path are left out. Start the query inside `keyed_state`.
    """
    version = F.col(version_col).cast("long") if version_col else F.lit(0).cast("long")
    return (
        sources.where(F.col("file_path").isNotNull())
        .select(
            "file_path", "content", F.coalesce(version, F.lit(0)).alias("version"),
            F.coalesce(F.sha2("content", 256), F.lit("")).alias("digest"),
        )
        .groupBy("file_path")
        .transformWithStateInPandas(Changes(), CHANGED, "append", "None")
    )


def _first_batch(spark: SparkSession, checkpoint: str, store: st.Store) -> tuple[int, bool]:
    """The store's batch number of micro-batch 0, fixed at the first start; and whether this is a restart."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/first_batch")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(where):
        return int(spark.read.text(where.toString()).first()[0]), True
    first = store.next_batch()
    out = system.create(where)
    out.write(str(first).encode())
    out.close()
    return first, False


def ingest_changes(
    sources: DataFrame,
    store: st.Store,
    embed: Embed,
    checkpoint: str,
    with_mappings: bool = False,
    version_col: str | None = None,
) -> StreamingQuery:
    """Keeps the store as the stream says: new files put in, changed ones replaced, deleted ones taken out.

    No stored row is read for that. Only the first micro-batch after a restart may have run before, so that
    one alone looks which rows of its own number are there already.
    """
    spark = store.spark
    first, again = _first_batch(spark, checkpoint, store)
    left = [again]

    def put(batch: DataFrame, number: int) -> None:
        batch_id, replayed = first + number, left.pop() if left else False
        changes = hold(batch)
        usable = changes.where((F.col("change") != GONE) & tx.not_blank("content")).select("file_path", "content")
        records = {st.CODE: chunking.code_records(usable)}
        if with_mappings:
            entries = hold(en.entries(lineage.field_mappings(usable)))
            records[st.MAPPINGS] = hold(st.batch_records(entries))
        old = changes.where(F.col("change") != NEW).select("file_path")
        for table, rows in records.items():
            if replayed:
                there = store.read(table).where(F.col("batch_id") == batch_id).select("id")
                rows = rows.join(there, "id", "left_anti")
            if table == st.MAPPINGS:
                rows = st.with_code(rows, usable)
            store.append(table, embedded_only(embed(rows, "document")), batch_id)
            # Deletes come after, up to the batch before: a run that breaks off leaves files doubled, never
            # missing, and the next one deletes again.
            store.delete_files(table, old, batch_id - 1)

    with keyed_state(spark):
        return (
            file_changes(sources, version_col)
            .writeStream.foreachBatch(put)
            .option("checkpointLocation", f"{checkpoint}/stream")
            .trigger(availableNow=True)
            .start()
        )
