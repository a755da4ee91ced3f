"""Answers that arrive in pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINE = "response string, message struct<content:string>, done boolean"
SLICE = 4096
PIECES = 1000  # rows that leave a task together
LINE_COLUMNS = "question_id bigint, seq bigint, chunk string, done boolean"


def decode_lines(lines: DataFrame, line_col: str = "line", keep_blank: bool = False) -> DataFrame:
    """Adds `chunk` and `done`: JSON lines of both forms, other text as it is; blank lines drop out.

    With `keep_blank` lines without text stay, with a null chunk, so that numbers have no gaps. Works on batch and streaming DataFrames.
    """
    line = F.col(line_col)
    parsed = F.from_json(line, LINE)
    is_object = F.startswith(F.ltrim(line), F.lit("{")) & F.get_json_object(line, "$").isNotNull()
    chunk = F.when(is_object, F.coalesce("__p.response", "__p.message.content")).otherwise(line)
    done = F.when(is_object, F.coalesce("__p.done", F.lit(False))).otherwise(False)
    filled = line.rlike(r"\S")
    if keep_blank:
        chunk, done = F.when(filled, chunk), F.coalesce(filled & done, F.lit(False))
    found = (
        lines.where(F.lit(True) if keep_blank else filled)
        .withColumn("__p", parsed)
        .withColumn("chunk", chunk)
        .withColumn("done", done)
        .drop("__p")
    )
    return found if keep_blank else found.where(F.col("chunk").isNotNull())


def _ordered_text(order: str, text: str) -> Column:
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(pieces, lambda p: p[text]), "")


def concat_until_done(
    chunks: DataFrame, key: str = "question_id", order: str = "seq", slice_rows: int = SLICE
) -> DataFrame:
    """The chunks of each question up to the first `done`, as one text.

    What comes after `done` is dropped before anything is gathered. Texts are joined in slices of
    the order column, then across slices, so a question with very many chunks is spread over tasks
    and only its finished text is one cell.
    """
    ends = chunks.where("done").groupBy(key).agg(F.min(order).alias("__end"))
    kept = chunks.join(ends, key, "left").where(
        F.col("__end").isNull() | (F.col(order) <= F.col("__end"))
    )
    return (
        kept.withColumn("__slice", F.floor(F.col(order) / F.lit(slice_rows)))
        .groupBy(key, "__slice")
        .agg(
            _ordered_text(order, "chunk").alias("__text"),
            F.count("*").alias("__n"),
            F.bool_or("done").alias("__done"),
        )
        .groupBy(key)
        .agg(
            _ordered_text("__slice", "__text").alias("answer"),
            F.sum("__n").alias("n_chunks"),
            F.bool_or("__done").alias("complete"),
        )
    )


def answers_stream(
    chunks: DataFrame, timeout_seconds: int | None = 600, first_seq: int | None = None
) -> DataFrame:
    """A stream of `(question_id, seq, chunk, done)` to one row per finished answer.

    The state of a question holds its chunks with their numbers until the answer is closed or nothing
    came for the timeout; then the answer goes out, in the order of the numbers. With `first_seq` an
    answer closes when all numbers from there to `done` are in, so chunks may arrive in any order over
    any number of micro-batches; without it (numbers may have gaps) it closes with `done`, and chunks
    may be out of order up to there. A mark is kept in place of the chunks so late ones are dropped,
    and goes with the next timeout.

    A timeout keeps the query running to watch the clock. For a run over what is there
    (`availableNow`) pass None: unfinished answers, and marks, then stay in the state.
    """

    def gather(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, seqs, texts, end = state.get if state.exists else (False, [], [], None)
        held = dict(zip(seqs, texts))
        if state.hasTimedOut:
            state.remove()
            if not closed:
                yield _answer(key[0], _cut(held, end), False)
            return
        if not closed:
            for batch in batches:
                held.update(zip(batch["seq"].tolist(), batch["chunk"].tolist()))
                ends = batch["seq"][batch["done"].astype(bool)].tolist()
                end = min([*ends, *([] if end is None else [end])], default=None)
            kept = _cut(held, end)
            if end is not None and (first_seq is None or len(kept) == end - first_seq + 1):
                yield _answer(key[0], kept, True)
                closed, held, end = True, {}, None
        state.update((closed, list(held), list(held.values()), end))
        if timeout_seconds is not None:
            state.setTimeoutDuration(timeout_seconds * 1000)

    return (
        chunks.select("question_id", "seq", "chunk", "done")
        .groupBy("question_id")
        .applyInPandasWithState(
            gather,
            "question_id bigint, answer string, n_chunks bigint, complete boolean",
            "closed boolean, seqs array<bigint>, texts array<string>, end bigint",
            "append",
            GroupStateTimeout.NoTimeout
            if timeout_seconds is None
            else GroupStateTimeout.ProcessingTimeTimeout,
        )
    )


def _cut(held: dict[int, str], end: int | None) -> list[str]:
    """The chunks in order, up to the end if there is one."""
    return [held[seq] for seq in sorted(held) if end is None or seq <= end]


def _answer(question_id, kept: list[str], complete: bool) -> pd.DataFrame:
    return pd.DataFrame(
        {"question_id": [question_id], "answer": ["".join(kept)], "n_chunks": [len(kept)], "complete": [complete]}
    )


def answer_chunks(
    prompts: DataFrame,
    make_stream: Callable[[], Callable[[str, str | None], Iterator[str]]],
    prompt_col: str = "prompt",
    system_col: str | None = None,
) -> DataFrame:
    """Answers in pieces: `(query_id, seq, chunk, done, error)` from `(query_id, prompt)`.

    `make_stream` runs once per task and gives a function from a prompt (and system text) to its pieces.
    The last row of an answer has `done` and no chunk; an error ends it with the error's text. Pieces
    leave the task in batches as they come, whole answers are never held.
    """
    rows = prompts.select(
        F.col("query_id").cast("bigint").alias("query_id"),
        F.col(prompt_col).alias("prompt"),
        (F.col(system_col) if system_col else F.lit(None)).cast("string").alias("system"),
    )
    names = ["query_id", "seq", "chunk", "done", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = make_stream()
        for batch in batches:
            for query_id, prompt, system in batch.itertuples(index=False):
                held, seq, error = [], 0, None
                try:
                    for piece in stream(prompt, system):
                        held.append((query_id, seq, piece, False, None))
                        seq += 1
                        if len(held) == PIECES:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                held.append((query_id, seq, None, True, error))
                yield pd.DataFrame(held, columns=names)

    return rows.mapInPandas(run, "query_id bigint, seq bigint, chunk string, done boolean, error string")
