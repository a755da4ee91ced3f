"""Answers put together from numbered pieces that arrive in any order, with one state entry per piece."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ANSWER = "question_id bigint, answer string, n_chunks bigint, complete boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which maps, timers and time-to-live need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Gather(StatefulProcessor):
    """The pieces of one question. A piece that comes is one put, whatever the answer already holds."""

    def __init__(self, first_seq: int, timeout_ms: int | None, keep_ms: int | None):
        self.first, self.timeout, self.keep = first_seq, timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "seq bigint", "chunk string")
        # How many numbers are in, and the least one with `done`.
        self.known = handle.getValueState("known", "n bigint, end bigint")
        self.closed = handle.getValueState("closed", "complete boolean", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            for _ in rows:  # too late: the answer went out
                pass
            return
        n, end = self.known.get() if self.known.exists() else (0, None)
        for batch in rows:
            for seq, chunk, done in zip(batch["seq"].tolist(), batch["chunk"].tolist(), batch["done"].tolist(), strict=True):
                if seq is None or seq != seq or seq < self.first:
                    continue
                seq = int(seq)
                n += not self.pieces.containsKey((seq,))
                self.pieces.updateValue((seq,), (chunk if isinstance(chunk, str) else None,))
                if done is True:
                    end = seq if end is None else min(end, seq)
        self.known.update((n, end))
        # Numbers beyond the end may be in too, so enough of them is not all of them.
        if end is not None and n >= end - self.first + 1:
            held = dict(self._held())
            if all(seq in held for seq in range(self.first, end + 1)):
                yield self._out(key, held, end, True)
                return
        if self.timeout is not None:
            self._forget_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for the timeout: what is there goes out, not complete."""
        if self.known.exists():
            yield self._out(key, dict(self._held()), self.known.get()[1], False)

    def close(self) -> None:
        pass

    def _held(self) -> Iterator[tuple[int, str | None]]:
        for seq, chunk in self.pieces.iterator():
            yield seq[0], chunk[0]

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)

    def _out(self, key, held: dict[int, str | None], end: int | None, complete: bool) -> pd.DataFrame:
        kept = [held[s] for s in sorted(held) if (end is None or s <= end) and held[s] is not None]
        self.pieces.clear()
        self.known.clear()
        self.closed.update((complete,))
        if self.timeout is not None:
            self._forget_timers()
        return pd.DataFrame(
            {"question_id": [key[0]], "answer": ["".join(kept)], "n_chunks": [len(kept)], "complete": [complete]}
        )


def answers_by_number(
    chunks: DataFrame,
    first_seq: int = 0,
    timeout_seconds: int | None = None,
    keep_seconds: int | None = None,
) -> DataFrame:
    """A stream of `(question_id, seq, chunk, done)` to one row per finished answer.

    An answer is complete when every number from `first_seq` to the least one with `done` is in, in any
    order, over any number of micro-batches and partitions; pieces that come twice count once, the later one
    holds, and pieces without text only fill their number. Without a timeout, answers with a gap wait in the
    state. With one they go out, not complete, when nothing came for that long; a query with a timeout
    keeps running to watch the clock. Once an answer is out later pieces are dropped; the mark for that is
    kept for `keep_seconds` after the answer, for ever by default.

    Start the query inside `keyed_state`.
    """
    timed = timeout_seconds is not None or keep_seconds is not None
    in_ms = [None if s is None else s * 1000 for s in (timeout_seconds, keep_seconds)]
    return (
        chunks.select("question_id", "seq", "chunk", "done")
        .groupBy("question_id")
        .transformWithStateInPandas(Gather(first_seq, *in_ms), ANSWER, "append", "ProcessingTime" if timed else "None")
    )
