"""Where a field goes across methods and files: field mappings followed from type to type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldtrace.session import hold

NODE = ["type", "field"]


def edges(field_mappings: DataFrame) -> DataFrame:
    """`(type, field, to_type, to_field)`, each once: a field of a source type goes into one of a target type.

    A null `field` and `to_field` stand for every field under its own name, as in a mapper method without
    annotations. Constants and values of unknown origin come from no field.
    """
    implicit = F.col("implicit")
    named = (
        F.coalesce(F.col("source_field"), F.lit("")).rlike(r"(?U)^[\w.\[\]]+$")
        & (F.col("source_field") != "unknown")
        & ~(F.col("value").isNotNull() & F.col("source_field").eqNullSafe(F.col("value")))
    )
    return (
        field_mappings.where(F.coalesce(implicit, F.lit(False)) | (named & F.col("target_field").isNotNull()))
        .where(F.col("source_type").isNotNull() & F.col("target_type").isNotNull())
        .select(
            F.col("source_type").alias("type"),
            F.when(~implicit, F.col("source_field")).alias("field"),
            F.col("target_type").alias("to_type"),
            F.when(~implicit, F.col("target_field")).alias("to_field"),
        )
        .distinct()
    )


def reached(field_mappings: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """`(start_type, start_field, type, field, hops)`: all fields that each start's values arrive in.

    `starts` has `type, field`. `hops` is the least number of mappings in between, 0 for the start itself.
    Each round follows only what the one before it found anew, and is written before the next reads it, so
    cycles end and the work is that of the fields reached. Up to `max_hops` rounds if given.
    """
    links = hold(edges(field_mappings))
    by_name = links.where(F.col("field").isNotNull())
    by_type = links.where(F.col("field").isNull()).select("type", "to_type")
    keys = ["start_type", "start_field", *NODE]
    new = hold(
        starts.where(F.col("type").isNotNull() & F.col("field").isNotNull())
        .select(F.col("type").alias("start_type"), F.col("field").alias("start_field"), *NODE, F.lit(0).alias("hops"))
        .distinct()
    )
    rounds, hops = [new], 0
    while max_hops is None or hops < max_hops:
        hops += 1
        named = new.join(by_name, NODE).select(
            "start_type", "start_field", F.col("to_type").alias("type"), F.col("to_field").alias("field")
        )
        alike = new.join(by_type, "type").select(
            "start_type", "start_field", F.col("to_type").alias("type"), "field"
        )
        seen = _union(rounds)
        found = named.unionByName(alike).distinct().join(seen, keys, "left_anti")
        new = hold(found.withColumn("hops", F.lit(hops)).select(*keys, "hops"))
        if new.isEmpty():
            break
        rounds.append(new)
        if len(rounds) > MERGE_ROUNDS:  # a long chain must not make a long plan
            rounds = [hold(_union(rounds))]
    return _union(rounds)


MERGE_ROUNDS = 8


def _union(rounds: list[DataFrame]) -> DataFrame:
    whole = rounds[0]
    for part in rounds[1:]:
        whole = whole.unionByName(part)
    return whole
