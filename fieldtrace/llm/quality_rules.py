"""Quality by rules that vote, and by how far each rule can be trusted.

Every rule says good, bad or nothing about a document. Documents with the same votes are counted together;
expectation-maximisation over these counts estimates how often each rule says what in good and in bad
documents, with no labels. A document is kept if the probability that it is good, given all votes, is
at least a half. All work on texts is done in DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrace.llm.common import SPACE, table, without

WINDOW = 8
SYMBOLS = "#*$%&|<>"
ROUNDS, CLOSE = 200, 1e-9
# What is believed before any estimate: the chance that a document is good if no rule says bad, if one
# does, or if more do; and how many of every hundred documents that belief goes on to weigh.
BELIEF, BELIEF_SHARE = (0.98, 0.1, 0.02), 0.05


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_again"
)


# === counts of a text ==========================================================================


def _repeat_words(hashes: Column) -> Column:
    """Words in windows that come twice or more, from the hashes of all windows in order."""
    # Equal windows side by side, by hash and then by place.
    sorted_ = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.element_at(F.transform(F.array(sorted_), _covered), 1)


def _covered(rows: Column) -> Column:
    n = F.greatest(F.size(rows), F.lit(1))
    sides = F.zip_with(F.slice(rows, F.lit(1), n - 1), F.slice(rows, F.lit(2), n - 1), lambda a, b: F.struct(
        (a["h"] == b["h"]).alias("same"), F.array(a["i"], b["i"]).alias("at")))
    places = F.flatten(F.transform(F.filter(sides, lambda s: s["same"]), lambda s: s["at"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))

    def cover(done: Column, at: Column) -> Column:
        return F.struct(
            (at + WINDOW).alias("end"),
            (done["words"] + at + WINDOW - F.greatest(done["end"], at)).alias("words"),
        )

    return F.aggregate(F.array_sort(F.array_distinct(places)), start, cover, lambda done: done["words"])


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the counts of COUNTS (long) of whole texts.

    Words are runs of anything but white space; null texts have none. Lines are parted by line feeds; a
    line with a word that equals an earlier one is a duplicate. Windows of eight words are told apart
    by 64-bit hashes of the hashes of their words. n_upper counts A-Z, n_again words that equal the
    word before. Columns of those names give way.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in without(docs, *COUNTS)]
    # Without white space at the start, only the end can give an empty part.
    parts = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    read = docs.select(
        *others,
        F.transform(parts, lambda w: F.xxhash64(w)).alias("\0words"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("\0lines"),
    )
    n = F.size("\0words")
    windows = F.when(
        n > WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))),
            lambda i: F.xxhash64(F.slice("\0words", i, F.lit(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    # The first word is compared with nothing.
    again = F.zip_with("\0words", F.slice("\0words", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    read = read.select(
        "*",
        n.cast("long").alias("n_words"),
        F.size(F.filter(again, lambda x: x)).cast("long").alias("n_again"),
        F.size("\0lines").cast("long").alias("n_lines"),
        (F.size("\0lines") - F.size(F.array_distinct("\0lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("\0windows"),
    )
    repeated = F.when(
        F.size(F.array_distinct("\0windows")) < F.size("\0windows"), _repeat_words(F.col("\0windows"))
    )
    found = read.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
    return found.select(*others, *COUNTS)


# === votes =====================================================================================


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes of all rules on a counted document: 1 good, -1 bad, 0 nothing."""
    words, chars = F.col("n_words"), F.col("word_chars")
    symbols, lines = F.col("n_symbols"), F.col("n_lines")
    mean = chars / F.greatest(words, F.lit(1))
    return {
        "length": _vote(words >= 50, words < 20),
        "repetition": _vote(F.lit(False), 100 * F.col("n_repeat_words") > 30 * words),
        "again": _vote(F.lit(False), 10 * F.col("n_again") > words),
        "symbols": _vote(200 * symbols <= chars, 100 * symbols > 4 * chars),
        "symbol_words": _vote(F.lit(False), 4 * symbols > words),
        "shouting": _vote(F.lit(False), 10 * F.col("n_upper") > 4 * chars),
        "duplicate_lines": _vote(F.lit(False), 2 * F.col("n_dup_lines") > lines),
        "word_length": _vote(F.lit(False), (mean < 2) | (mean > 15)),
        "line_length": _vote(words >= 4 * lines, words < 2 * lines),
    }


# === trust in the rules ========================================================================


def fit(patterns: Sequence[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Share of good documents, and for each rule and vote its log probability if good and if bad.

    `patterns` are the different rows of votes and their numbers of documents: never more than
    three to the number of rules. Votes are taken as independent of each other, given the quality.
    The first guess holds documents that no rule objects to for good, and keeps some weight, so the
    estimate cannot turn good into bad.
    """
    total = sum(n for _, n in patterns)
    width = len(patterns[0][0])
    guess = [BELIEF[min(2, votes.count(-1))] for votes, _ in patterns]
    chance, before = list(guess), -math.inf
    for _ in range(ROUNDS):
        weights = [
            (n * (p + BELIEF_SHARE * g), n * (1 - p + BELIEF_SHARE * (1 - g)))
            for (_, n), p, g in zip(patterns, chance, guess, strict=True)
        ]
        sums = [sum(w[side] for w in weights) for side in (0, 1)]
        share = sums[0] / (sums[0] + sums[1])
        tables = []
        for r in range(width):
            seen = {vote: [0.0, 0.0] for vote in (-1, 0, 1)}
            for (votes, _), w in zip(patterns, weights, strict=True):
                seen[votes[r]][0] += w[0]
                seen[votes[r]][1] += w[1]
            # A vote that was never seen is as likely as one in a thousand documents in all.
            tables.append(
                {v: tuple(math.log((x[s] + 1e-3 * total) / (sums[s] + 3e-3 * total)) for s in (0, 1)) for v, x in seen.items()}
            )
        chance = [posterior(share, tables, votes) for votes, _ in patterns]
        if abs(share - before) < CLOSE:
            break
        before = share
    return share, tables


def posterior(share: float, tables: list[dict[int, tuple[float, float]]], votes: Sequence[int]) -> float:
    """The probability that a document with these votes is good."""
    odds = math.log(share) - math.log(1 - share)
    odds += sum(t[v][0] - t[v][1] for t, v in zip(tables, votes, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with their counts, base_failed, p_good and kept.

    base_failed: fewer than 20 words, or more than 30 of 100 words in repeated windows; such documents
    are not kept, the others if p_good >= 0.5. The rules' accuracies come from all rows, so rows that
    repeat count each time. Null and empty texts fail. An empty table gives no rows.
    """
    votes = rules()
    counted = counts(docs, text_col)
    voted = counted.select("*", F.struct(*[v.cast("int").alias(k) for k, v in votes.items()]).alias("\0votes"))
    # One row for each different row of votes, however many documents there are.
    seen = sorted((tuple(r[0]), r[1]) for r in voted.groupBy("\0votes").count().collect())
    share, tables = fit(seen) if seen else (0.5, [])
    odds = F.lit(math.log(share) - math.log(1 - share))
    for name, known in zip(votes, tables, strict=False):
        vote = F.col(f"\0votes.{name}")
        up, down, none = (known[v][0] - known[v][1] for v in (1, -1, 0))
        odds = odds + F.when(vote > 0, up).when(vote < 0, down).otherwise(none)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    columns = [F.col(f"`{c}`") for c in without(counted, "base_failed", "p_good", "kept")]
    found = voted.select(*columns, failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("p_good"))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text", "n_lines").withColumn("p_good", F.round("p_good", 9))
