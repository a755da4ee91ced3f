"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Of all rates that give each source its
target of words, and none above a limit, those closest to one copy each (by relative entropy) are
exponentially tilted: rate = min(limit, exp(multiplier * size)). The multipliers solve the convex dual
by Newton steps; each step is one aggregate over the table of sizes, for all sources at once. Sums are
taken in decimals, so they do not depend on the order of rows. Rates are then rounded to copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.llm.common import table, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0
BUCKET_ROWS = 1024  # rows of a source that are rounded together, on average
STEPS, CLOSE = 100, 1e-9
SUM = "decimal(38,6)"


@dataclass
class Source:
    """What a source has and shall have."""

    name: str | None
    size: int
    rows: int
    weight: float
    target: float = 0.0
    multiplier: float = 0.0


def targets(sources: Sequence[Source], limit: float = LIMIT) -> None:
    """Shares all words by weight. What is above `limit` times a source's size goes to the others."""
    left, open_ = float(sum(s.size for s in sources)), [s for s in sources if s.weight > 0]
    while open_:
        weight = sum(s.weight for s in open_)
        full = [s for s in open_ if left * s.weight / weight >= limit * s.size]
        if not full:
            for source in open_:
                source.target = left * source.weight / weight
            return
        for source in full:
            source.target = limit * source.size
        left -= sum(s.target for s in full)
        open_ = [s for s in open_ if s not in full]


def _tilt(sizes: DataFrame, sources: Sequence[Source], limit: float) -> None:
    """Newton steps for all multipliers, inside brackets that shrink with every step."""
    spark = sizes.sparkSession
    scale = {s.name: s.size / s.rows for s in sources if s.size}
    todo = {s.name: s for s in sources if s.size and 0 < s.target < limit * s.size * (1 - CLOSE)}
    low, high = dict.fromkeys(todo, -math.inf), dict.fromkeys(todo, math.inf)
    for _ in range(STEPS):
        if not todo:
            return
        # One row per source of the mix.
        now = spark.createDataFrame(
            [(s.name, s.multiplier / scale[s.name]) for s in todo.values()], "name string, tilt double"
        )
        power = F.least(F.col("tilt") * F.col("size"), F.lit(math.log(limit)))
        words = F.exp(power) * F.col("size") * F.col("rows")
        slope = F.when(F.col("tilt") * F.col("size") < math.log(limit), words * F.col("size"))
        found = (
            sizes.join(F.broadcast(now), F.col("source").eqNullSafe(F.col("name")))
            .groupBy("name")
            .agg(F.sum(words.cast(SUM)).alias("words"), F.sum(slope.cast(SUM)).alias("slope"))
            .collect()
        )
        for row in found:
            source, unit = todo[row.name], scale[row.name]
            off = float(row.words) - source.target
            if abs(off) <= CLOSE * source.target:
                del todo[row.name]
                continue
            at = source.multiplier
            (high if off > 0 else low)[row.name] = at
            a, b = low[row.name], high[row.name]
            step = at - off / (float(row.slope) / unit) if row.slope else math.nan
            if not a < step < b:
                step = (a + b) / 2 if math.isfinite(a + b) else at + math.copysign(max(1.0, abs(at)), -off)
            if step in (a, b, at):
                del todo[row.name]
            source.multiplier = step


def _rounded(rows: pd.DataFrame, limit: float) -> np.ndarray:
    """Copies of rows, largest first: each rate up or down, whichever brings the words so far closer."""
    want = np.cumsum(rows["rate"].to_numpy() * (rows["size"] * rows["m"]).to_numpy())
    copies, taken = np.zeros(len(rows), dtype=np.int64), 0
    for i, (rate, size, m) in enumerate(zip(rows["rate"], rows["size"], rows["m"], strict=True)):
        least = math.floor(rate)
        more = rate > least and size and want[i] - taken - least * size * m > size * m / 2
        copies[i] = min(least + bool(more), int(limit))
        taken += int(copies[i] * size * m)
    return copies


def _salted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn("\0salt", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    limit: float = LIMIT,
) -> DataFrame:
    """How often each document is taken: id, salt, source, size, m, rate, copies, source_size, target.

    The sources by code point, null last, have the weights in turn. One row stands for `m` rows of
    `docs` that agree in id, text and source (salt is a hash of id and text); each of them gets `copies`.
    Sizes count words; null texts and texts without words have none, keep one copy and take nothing.
    Rounding keeps each bucket of about BUCKET_ROWS rows, and so each source, close to its target,
    and gives the same copies on every run. An empty table gives an empty mixture.
    """
    spark = docs.sparkSession
    narrow = _salted(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col("\0salt").alias("salt"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
    )
    rows = written(
        narrow.groupBy("id", "salt", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-rows"
    )
    sizes = written(rows.groupBy("source", "size").agg(F.sum("m").alias("rows")), "mix-sizes")
    # The sources of a mix are few: each has a weight that somebody chose.
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")), F.sum("rows")).collect()
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sources = [
        Source(name, int(size), int(n), weights[i % len(weights)])
        for i, (name, size, n) in enumerate(totals)
    ]
    targets(sources, limit)
    _tilt(sizes, sources, limit)
    plan = spark.createDataFrame(
        [
            (s.name, s.size, s.target, s.multiplier * s.rows / s.size if s.size else 0.0,
             s.target >= limit * s.size * (1 - CLOSE), s.target > 0, -(-s.rows // BUCKET_ROWS))
            for s in sources
        ],
        "name string, source_size long, target double, tilt double, full boolean, used boolean, buckets long",
    )
    rate = (
        F.when(F.col("size") == 0, 1.0)
        .when(~F.col("used"), 0.0)
        .when(F.col("full"), limit)
        .otherwise(F.least(F.lit(limit), F.exp(F.col("tilt") * F.col("size"))))
    )
    rated = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name"))).select(
        "id", "salt", "source", "size", "m", "source_size", "target", rate.alias("rate"),
        F.pmod(F.col("salt"), F.col("buckets")).alias("bucket"),
    )

    def rounded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "salt"], ascending=[False, True], kind="stable")
        return part.assign(copies=_rounded(part, limit))

    schema = ", ".join(f"{name} {kind}" for name, kind in rated.dtypes) + ", copies long"
    return rated.groupBy("source", "bucket").applyInPandas(rounded, schema).drop("bucket")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    limit: float = LIMIT,
) -> DataFrame:
    """The rows of `docs`, each as often as the mixture takes it; the columns stay."""
    taken = mixture(docs, id_col, text_col, source_col, weights, limit).select(
        F.col("id").alias("\0id"), F.col("salt").alias("\0of"), F.col("source").alias("\0source"),
        F.col("copies").cast("int").alias("\0copies"),
    ).where(F.col("\0copies") > 0)
    same = (
        F.col("\0salt").eqNullSafe(F.col("\0of"))
        & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("\0id"))
        & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("\0source"))
    )
    found = _salted(docs, id_col, text_col).join(taken, same)
    found = found.withColumn("\0copy", F.explode(F.expr("array_repeat(0, `\0copies`)")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    each = found.withColumn("row", F.explode(F.expr("array_repeat(0, cast(m as int))")))
    return each.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "source",
        "rate",
        "copies",
    )
