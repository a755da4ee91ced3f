"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldtrace.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    joined = both.join(least, "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("least", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return joined.unionByName(least.withColumnRenamed("least", "b"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component of every linked node: the smallest id that can be reached.

    Large and small stars in turn until nothing changes; each round ends in a written table. Links to
    null or to itself count as none. A hub's links are never in one group: minima are taken before
    the shuffle, and the joins are plain ones, which Spark splits where a key is frequent.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    edges = written(edges.distinct(), "links")
    state = None
    while True:
        large = _large_star(edges).where(F.col("a") != F.col("b")).distinct()
        small = _small_star(large).where(F.col("a") != F.col("b")).distinct()
        edges = written(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.distinct()
    )
