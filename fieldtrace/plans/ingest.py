"""From source texts to stored code and mapping records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fieldtrace.functions import text as tx
from fieldtrace.operators import chunking
from fieldtrace.plans import entries as en, lineage
from fieldtrace.session import hold
from fieldtrace.sources import store as st

Embed = Callable[[DataFrame, str], DataFrame]


def ingest(
    store: st.Store,
    sources: DataFrame,
    embed: Embed,
    mode: str = "skip",
    with_mappings: bool = False,
    batch_id: int | None = None,
) -> int:
    """Chunks, vectors and code records of sources; `with_mappings` fills the mapping table too.

    Mappings are otherwise extracted from what a question retrieves.
    """
    usable = sources.where(F.col("content").isNotNull() & tx.not_blank("content"))
    batch_id = store.add_code(chunking.code_records(usable), embed, mode, batch_id)
    if with_mappings:
        if mode == "replace":
            paths = usable.select("file_path").distinct()
            store.delete_files(st.MAPPINGS, paths, batch_id - 1)
        entries = hold(en.entries(lineage.field_mappings(usable)))
        store.add_mappings(st.batch_records(entries), embed, batch_id, usable)
    return batch_id


def ingest_log(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """What became of each file: stored, skipped (nothing to store or no vector) or failed."""
    found = stored.select("file_path").distinct().withColumn("code_stored", F.lit(True))
    error = F.col("error") if "error" in sources.columns else F.lit(None).cast("string")
    is_stored = F.coalesce("code_stored", F.lit(False))
    return (
        sources.select("file_path", error.alias("error"))
        .join(found, "file_path", "left")
        .select(
            F.col("file_path").alias("file"),
            F.when(F.col("error").isNotNull(), "failed")
            .when(is_stored, "stored")
            .otherwise("skipped")
            .alias("status"),
            is_stored.alias("code_stored"),
            "error",
        )
    )
