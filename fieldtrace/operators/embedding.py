"""Text to vectors through a batch function, and the offline default embedder."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from fieldtrace import fixed
from fieldtrace.functions import text as tx

HASH_DIM = 64
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"

EmbedBatch = Callable[[list[str]], list]


@lru_cache(maxsize=1 << 20)
def _hash32(word: str) -> int:
    """The first 32 bits of md5, the same in every engine."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")


# ASCII characters that belong to no word, as spaces; the bytes of all others are left as they are.
ASCII_WORDS = bytes(b if b >= 128 or chr(b).isalnum() or b == ord("_") else 32 for b in range(256))


def _buckets(words: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of distinct pieces of texts, one after the other, and how many each piece has.

    A piece is a word, unless other characters than ASCII part it.
    """
    plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern_regex(words.filter(pa.array(~plain)), pattern=BETWEEN_WORDS)
    inside, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    real = pc.not_equal(inside, "")
    at = np.flatnonzero(~plain)[owner[real.to_numpy(zero_copy_only=False)]]
    counts = np.ones(len(words), dtype=np.int64)
    counts[~plain] = np.bincount(at, minlength=len(words))[~plain]
    found = np.empty(int(counts.sum()), dtype=np.int64)
    starts = np.cumsum(counts) - counts
    found[starts[plain]] = [_hash32(w) for w in words.filter(pa.array(plain)).to_pylist()]
    is_part = np.repeat(~plain, counts)
    found[is_part] = [_hash32(w) for w in inside.filter(real).to_pylist()]
    return found % dim, counts


def count_buckets(texts: pa.Array, dim: int) -> pa.Array:
    """Per text the number of words in each hash bucket; null for texts without words.

    Texts are cut at ASCII characters that are in no word. What stands between them is told apart by Arrow, and
    only what is new to a batch is looked at further; each word that is new to the worker is hashed once.
    """
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    cut = pa.py_buffer((data.to_pybytes() if data else b"").translate(ASCII_WORDS))
    spaced = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, cut], 0, texts.offset)
    lists = pc.ascii_split_whitespace(spaced)
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(words, "")
    words, owner = words.filter(real).dictionary_encode(), owner[real.to_numpy(zero_copy_only=False)]
    buckets, counts = _buckets(words.dictionary, dim)
    word = words.indices.to_numpy()
    n, size = len(texts), counts[word]
    # Most pieces are one word; the others give several buckets, or none.
    first = np.repeat((np.cumsum(counts) - counts)[word] - (np.cumsum(size) - size), size)
    at = np.repeat(owner, size) * dim + buckets[first + np.arange(len(first))]
    table = np.bincount(at, minlength=n * dim).astype(np.float32)
    empty = np.bincount(np.repeat(owner, size), minlength=n) == 0
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    # A null offset instead would give a null's entries to the vector before it.
    return pa.ListArray.from_arrays(offsets, pa.array(table), mask=pa.array(empty))


def hash_embed(
    df: DataFrame, text_col: str = "document", out: str = "embedding", dim: int = HASH_DIM
) -> DataFrame:
    """Feature hashing over whole texts: vector entry = number of words in that bucket.

    One Arrow function over the text column; no other column goes to Python. Texts without words
    get a null vector.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def count(texts: pa.Array) -> pa.Array:
        return count_buckets(texts, dim)

    # A filter on the vector would else be pushed below it and count a second time.
    return df.withColumn(out, count.asNondeterministic()(text_col))


def with_retries(
    embed: EmbedBatch, texts: list[str], max_retries: int = 3, wait: float = 0.5
) -> list:
    """Vectors of a batch in order; null where a text is blank or no try gave a vector.

    A text's vector never depends on its neighbours: after an error the batch is halved down to the
    texts that cause it. Only such a text is tried again shortened, and texts without a vector are
    tried again as they are.
    """
    vectors: list = [None] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and t.strip()]
    for attempt in range(max_retries):
        if not todo:
            break
        if attempt:
            time.sleep(wait * attempt)
        found = _halving(embed, [texts[i] for i in todo])
        for i, vector in zip(todo, found):
            if vector is not None and len(vector):
                vectors[i] = vector
        todo = [i for i in todo if vectors[i] is None]
    return vectors


def _halving(embed: EmbedBatch, texts: list[str]) -> list:
    try:
        got = list(embed(texts))
        if len(got) == len(texts):
            return got
    except Exception:
        pass
    if len(texts) > 1:
        half = len(texts) // 2
        return _halving(embed, texts[:half]) + _halving(embed, texts[half:])
    try:
        return list(embed([_shorter(texts[0])]))[:1] or [None]
    except Exception:
        return [None]


def _shorter(text: str) -> str:
    n = fixed.EMBED_RETRY_MAX_CHARS
    return text[:n] + fixed.EMBED_RETRY_MARKER if len(text) > n else text


def embed_with(
    df: DataFrame,
    make_embed: Callable[[], EmbedBatch],
    text_col: str = "document",
    out: str = "embedding",
    max_retries: int = 3,
    wait: float = 0.5,
    concurrency: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Vectors from a user's batch function, null where it failed or the text is blank.

    `make_embed` runs once per partition and returns the function `texts -> vectors`, so a client
    is built once. `concurrency` caps the number of tasks that call the model at one time. Whole texts
    go to the model, or with `max_chars` texts cut there and marked.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make_embed()
        for batch in batches:
            yield pd.Series(with_retries(embed, batch.tolist(), max_retries, wait))

    if concurrency:
        df = df.repartition(concurrency)
    text = F.col(text_col) if max_chars is None else tx.clip(text_col, max_chars, fixed.EMBED_MARKER)
    return df.withColumn(out, vectors.asNondeterministic()(text))


def embedded_only(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0))


def mapping_context(entries: DataFrame) -> DataFrame:
    """Adds the sentence a mapping is embedded by."""
    n = F.coalesce(F.size("field_mappings"), F.lit(0))
    return entries.withColumn(
        "embedding_context",
        F.concat(
            F.lit("Mapping from "),
            tx.default_text("source_type", "None"),
            F.lit(" to "),
            tx.default_text("target_type", "None"),
            F.when(n > 0, F.concat(F.lit(" with "), n.cast("string"), F.lit(" field mappings")))
            .otherwise(""),
        ),
    )


def embed_mappings(entries: DataFrame, embed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Entries with `embedding_context`, its vector and `has_embedding`.

    `embed(df, text_col)` adds the column `embedding`, e.g. `hash_embed`.
    """
    return embed(mapping_context(entries), "embedding_context").withColumn(
        "has_embedding", F.col("embedding").isNotNull()
    )
