"""Tables with everything that can be odd, for all operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, Score double, ids string, "
    "n_lines string, kept string, spans string, `a.b` int"
)
WORDS = "the of and in that report river mountain signal paper window garden silver number letter".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(50)) for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, empty and very long texts, ties, repeated rows and ids."""
    line = "This line stands in many of the documents, word for word."
    rows = [(i, prose(i, 60) + f"\n  {line.upper() if i % 2 else line}\t", f"s{i % 3}") for i in range(8)]
    rows += [
        (20, None, "s0"), (21, "", None), (22, " \t\n\x0b\x0c\r ", "s1"), (23, "one", "s1"),
        (24, prose(24, 30_000), "s2"), (25, "日本語 é ñ▁ \x1c\x85 \U0001f600", None),
        (26, prose(3, 60), "s0"), (26, prose(3, 60), "s0"), (26, prose(5, 61), "s1"),
        (None, prose(3, 60), None), (None, None, None), (-5, "x" * 5000, "s1"), (27, "a\x00b\n\n\nc", "s2"),
        (28, f"{line}\n{line}\n short \n{line}", "s2"),
    ]
    return rows


def frame(spark: SparkSession, rows=None) -> DataFrame:
    rows = texts() if rows is None else rows
    full = [(i, t, "en", s, 0 if t is None else len(t), 0.5, "x", "y", "z", "w", 1) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
