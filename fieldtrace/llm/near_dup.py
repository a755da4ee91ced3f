"""Near duplicates by bottom-k sketches of one hash function.

Each set of shingles keeps its k smallest hashes. Inverted lists of the retained values give overlaps:
two sketches that overlap as much as similar sets do must share one of their rarest values, so only those
are listed, and passages that many texts share make no lists. In a list nothing is paired off: every
member meets the list's most central one. What is still apart after that meets the list's other
members, if counts of its unshared shingles leave that possible. Pairs go through an estimate on the
union of both sketches, and then an exact comparison of the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrace.llm.common import blocks, table, written
from fieldtrace.llm.components import components
from fieldtrace.llm.shingles import shingle_sets
from fieldtrace.session import small

SKETCH = 64
WIDTH = 5
PERCENT = 80
MISSED = 1e-7  # chance that a pair just similar enough overlaps less than asked


def least_overlap(percent: int, k: int = SKETCH, missed: float = MISSED) -> int:
    """How many of the k smallest hashes of a union both sets hold, but for a chance of `missed`."""
    p, below = percent / 100, 0.0
    for overlap in range(k + 1):
        below += math.comb(k, overlap) * p**overlap * (1 - p) ** (k - overlap)
        if below > missed:
            return overlap
    return k


def _sketches(docs: DataFrame, k: int, width: int) -> DataFrame:
    """id, n (size of the set), d1 and d2 (digest of the set), sketch (its k smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text"):
            sets = shingle_sets(texts, width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate([*sets, np.empty(0, np.int64)])
            ends = np.cumsum(n)
            digests = []
            for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                x = flat.view(np.uint64) * np.uint64(factor)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(x ^ (x >> np.uint64(29)), dtype=np.uint64)])
                digests.append((sums[ends] - sums[ends - n]).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum(np.minimum(n, k))]).astype(np.int32)
            kept = pa.ListArray.from_arrays(
                offsets, pa.array(np.concatenate([s[:k] for s in sets] or [flat]), pa.int64())
            )
            out = pa.table(
                {"id": rows["id"], "n": n, "d1": digests[0], "d2": digests[1], "sketch": kept}
            )
            yield from out.to_batches()

    schema = "id long, n long, d1 long, d2 long, sketch array<long>"
    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, n, members (all shingles, smallest hash first) of the texts with one of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text"):
            sets = shingle_sets(texts, width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            members = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets), pa.int64()))
            yield from pa.table({"id": rows["id"], "n": n, "members": members}).to_batches()

    chosen = docs.join(small(ids), "id", "left_semi")
    return chosen.select("id", "text").mapInArrow(run, "id long, n long, members array<long>")


def _alike(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def _sizes_allow(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    of = {
        side: sets.select(
            F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("members").alias(f"set_{side}")
        )
        for side in "ab"
    }
    joined = pairs.join(of["a"], "a").join(of["b"], "b")
    # The k smallest of the union, and how many of them both hold.
    first, second = F.slice("set_a", 1, k), F.slice("set_b", 1, k)
    union = F.slice(F.array_sort(F.array_union(first, second)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(first, second)))
    likely = both >= F.when(F.size(union) < k, F.size(union) * percent / 100).otherwise(
        least_overlap(percent, k)
    )
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        joined.where(likely)
        .where(_alike(common, F.col("n_a"), F.col("n_b"), percent))
        .select("a", "b")
        .distinct()
    )


def _lists(sketches: DataFrame, percent: int, k: int) -> DataFrame:
    """value, id, n, score: each set's entries in the inverted lists it cannot do without.

    Of a sketch with m values, an overlap of at least o means that one of its m - o + 1 rarest is
    shared. Values that no other set retains make no list but count among the rarest. score is the
    summed length of all lists a sketch stands in: high for a set in the middle of its like.
    """
    entries = sketches.select("id", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    own = (
        entries.join(shared, "value")
        .groupBy("id", "n", "m")
        .agg(
            F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"),
            F.sum("df").alias("score"),
        )
    )
    # Sketches overlap as whole sets do if no partner has more than k members.
    whole = F.ceil(F.col("n") * percent / 100)
    kept_whole = 100 * F.col("n") < percent * (k + 1)
    overlap = F.when(kept_whole, whole).otherwise(F.least(whole, F.lit(least_overlap(percent, k))))
    listed = (F.size("values") - overlap + 1).cast("int")
    return (
        own.where(listed > 0)
        .withColumn("values", F.slice("values", F.lit(1), F.greatest(listed, F.lit(0))))
        .select("id", "n", "score", F.explode("values.value").alias("value"))
    )


def _heads(lists: DataFrame) -> DataFrame:
    """value, head (the most central member, with its n) and the extremes of its members' ids."""
    found = lists.groupBy("value").agg(
        F.max(F.struct("score", (-F.col("id")).alias("order"), "id", "n")).alias("head"),
        F.min("id").alias("first"),
        F.max("id").alias("last"),
    )
    return found.where(F.col("first") != F.col("last")).select(
        "value", F.col("head.id").alias("head"), F.col("head.n").alias("n_head")
    )


def _rest(lists: DataFrame, joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one list that are in different components yet and may be similar.

    Lists whose members are all joined are done. For the others the whole sets decide: similar sets
    share one of the few shingles that are rarest among the members, as many as may be missing. Edits
    make rare shingles, so a set with enough of its own has no partner, or few.
    """
    placed = lists.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_lists = (
        placed.groupBy("value")
        .agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("shortest")
        )
        .where(F.col("low") != F.col("high"))
        .select("value", "shortest")
    )
    members = written(
        placed.join(open_lists, "value")
        .groupBy("id")
        .agg(
            F.first("component").alias("component"),
            F.max("score").alias("score"),
            F.min("shortest").alias("shortest"),
        ),
        "open-members",
    )
    entries = sets.join(members.select("id"), "id", "left_semi").select(
        "id", "n", F.explode("members").alias("shingle")
    )
    shared = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    own = (
        entries.join(shared, "shingle")
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("common"))
        .join(members, "id")
    )
    # Partners of n' members, with `least` the smallest n' there is: (1 + t) overlap >= t (n + n').
    least = F.greatest("shortest", F.ceil(F.col("n") * percent / 100))
    overlap = F.ceil(percent * (F.col("n") + least) / (100 + percent))
    listed = (F.size("common") - overlap + 1).cast("int")
    able = written(
        own.where(listed > 0)
        .withColumn("common", F.slice("common", F.lit(1), F.greatest(listed, F.lit(0))))
        .select("id", "n", "component", "score", F.explode("common.shingle").alias("shingle")),
        "open-lists",
    )
    main = (
        able.groupBy("shingle")
        .agg(
            F.max(F.struct("score", (-F.col("id")).alias("order"), "component")).alias("head"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        .where(F.col("low") != F.col("high"))
        .select("shingle", F.col("head.component").alias("main"))
    )
    able = able.join(main, "shingle")
    x = able.where(F.col("component") != F.col("main")).select(
        "shingle", "main", *[F.col(c).alias(f"{c}_x") for c in ("id", "n", "component")]
    )
    y = able.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("id", "n", "component")])
    possible = (
        (F.col("component_x") != F.col("component_y"))
        & ((F.col("component_y") == F.col("main")) | (F.col("id_x") < F.col("id_y")))
        & _sizes_allow(F.col("n_x"), F.col("n_y"), percent)
    )
    return x.join(y, "shingle").where(possible).select(_pair("id_x", "id_y")).select("p.*").distinct()


def _pair(x: str, y: str) -> Column:
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).alias("p")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    width: int = WIDTH,
    k: int = SKETCH,
) -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id, kept.

    Sets of `width`-word shingles (words without case, for A-Z) are linked if 100 * intersection >=
    `percent` * union; component_id is the smallest id that can be reached, kept says that it is the
    row's own. Rows with equal sets are one member while links are sought. A row without words, or
    with null text, has 0 shingles and stands alone. Rows with a null id stand alone too, with a null
    component_id, and are kept. Rows that share an id share a component, and of equal rows all are
    kept or none.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = written(_sketches(narrow, k, width), "sketches")
    digest = ["d1", "d2", "n"]
    full = sketches.where((F.col("n") > 0) & F.col("id").isNotNull())
    first = written(full.groupBy(*digest).agg(F.min("id").alias("id")), "first-of-equals")
    members = full.select("id", *digest, "sketch").dropDuplicates(["id", *digest])
    members = members.join(first, ["id", *digest], "left_semi")

    lists = written(_lists(members, percent, k), "lists")
    heads = _heads(lists)
    near = lists.join(heads, "value").where(
        (F.col("id") != F.col("head")) & _sizes_allow(F.col("n"), F.col("n_head"), percent)
    )
    pairs = written(near.select(_pair("id", "head")).select("p.*").distinct(), "pairs")
    listed = written(
        lists.join(heads.select("value"), "value", "left_semi").select("id").distinct(), "listed"
    )
    sets = written(_sets(narrow, listed, width), "sets")
    links = written(_confirmed(pairs, sets, percent, k), "star-links")
    rest = written(_rest(lists, components(links), sets, percent), "rest-pairs")
    links = links.unionByName(_confirmed(rest, sets, percent, k))

    # Equal sets hang on the first of them; an id with several texts joins all of their components.
    equal = full.select("id", *digest).join(first.withColumnRenamed("id", "first"), digest)
    equal = equal.where(F.col("id") != F.col("first")).select(
        F.col("id").alias("a"), F.col("first").alias("b")
    )
    found = components(links.unionByName(equal))
    result = sketches.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
    result = result.withColumn("component", F.coalesce("component", "id"))
    return result.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, percent=85)


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
    end as s from words),
flat as (select doc_id, len(s) as n, unnest(s) as x from sets),
links as (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.x = b.x and a.doc_id <> b.doc_id
    and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.b as component_id, c.b = s.doc_id as kept
from sets s join (select a, min(b) as b from reach group by a) c on c.a = s.doc_id"""
