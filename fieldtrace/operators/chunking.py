"""Fixed-size chunks of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldtrace import fixed
from fieldtrace.functions import text as tx


def chunk_texts(
    df: DataFrame, text_col: str = "content", size: int = fixed.CHUNK_SIZE
) -> DataFrame:
    """Every text cut into pieces of `size` characters: adds `chunk_index`, `total_chunks`, `document`.

    An empty text has no chunk. The input columns but the text are kept.
    """
    if size < 1:
        raise ValueError("size must be positive")
    keep = [c for c in df.columns if c != text_col]
    total = F.ceil(F.length(text_col) / F.lit(size)).cast("int")
    # One pass over the text: a substring per chunk would walk to its start again every time.
    pieces = F.regexp_extract_all(F.col(text_col), F.lit("(?s).{1,%d}" % size), F.lit(0))
    return df.select(
        *keep,
        total.alias("total_chunks"),
        F.posexplode(pieces).alias("chunk_index", "document"),
    ).select(*keep, "chunk_index", "total_chunks", "document")


def code_records(
    sources: DataFrame,
    path_col: str = "file_path",
    text_col: str = "content",
    size: int = fixed.CHUNK_SIZE,
) -> DataFrame:
    """Records of the code table without vectors: short files whole, longer ones in chunks."""
    whole = F.col("total_chunks") <= 1
    return (
        chunk_texts(sources.select(F.col(path_col).alias("file_path"), text_col), text_col, size)
        .withColumn("chunk_index", F.when(~whole, F.col("chunk_index")))
        .withColumn("total_chunks", F.when(~whole, F.col("total_chunks")))
        .select(
            tx.chunk_id("file_path", "chunk_index").alias("id"),
            "file_path",
            tx.basename("file_path").alias("file_name"),
            tx.suffix("file_path").alias("file_type"),
            "chunk_index",
            "total_chunks",
            "document",
        )
    )


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with the vector of the same file and index; chunks without one are dropped."""
    return chunks.join(
        vectors.select("file_path", "chunk_index", "embedding"), ["file_path", "chunk_index"]
    )


def join_chunks(records: DataFrame) -> DataFrame:
    """`(file_path, content)` with the chunks of each file in order."""
    pieces = F.array_sort(
        F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(0)).alias("i"), "document"))
    )
    return records.groupBy("file_path").agg(
        F.array_join(F.transform(pieces, lambda p: p["document"]), "").alias("content")
    )


def chunks_stored(records: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Per file: chunks with a vector, and chunks in all."""
    return records.groupBy(path_col).agg(
        F.count_if(F.col("embedding").isNotNull()).alias("n_stored"),
        F.max(F.coalesce("total_chunks", F.lit(1))).alias("n_total"),
    )
