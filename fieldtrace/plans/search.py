"""Text search over stored records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fieldtrace import fixed
from fieldtrace.functions import text as tx
from fieldtrace.operators import knn
from fieldtrace.session import hold, small


def search(
    records: DataFrame,
    texts: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame],
    k: int = fixed.DEFAULT_RESULTS,
    where: dict | None = None,
    metric: str = "cosine",
    preview_chars: int = fixed.PREVIEW_CHARS,
) -> DataFrame:
    """The `k` nearest records of every text of `texts` (`query_id, text`).

    Gives query_id, rank, id, distance, similarity (a percentage as text), the records' metadata, and
    the first `preview_chars` characters of their text as preview. Texts are embedded once; only the
    hits' records are joined to their metadata.
    """
    asked = embed(texts.select("query_id", "text"), "text")
    hits = hold(knn.nearest(records, asked, k, where, metric))
    metadata = [c for c in records.columns if c not in ("id", "embedding", "document")]
    shown = records.select("id", *metadata, tx.preview("document", preview_chars).alias("preview"))
    found = shown.join(small(hits), "id")
    return found.select(
        "query_id", "rank", "id", "distance", tx.percent_text(knn.similarity()).alias("similarity"),
        *metadata, "preview",
    )
