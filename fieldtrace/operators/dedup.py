"""Insert-if-absent, ids made unique inside a batch, removal of double mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from fieldtrace.session import hold, small

SLICE = 65536


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """One row for each id of `new` that is not in `existing`.

    The stored ids among the new ones are looked up first. For a batch of some size the new ids are
    broadcast, so the stored table, which may be far larger, is read in place and never shuffled.
    """
    ids = small(hold(new.select(key)))
    known = hold(existing.select(key).join(ids, key, "left_semi").distinct())
    return new.join(small(known), key, "left_anti").dropDuplicates([key])


def unique_ids(df: DataFrame, key: str = "id", order: str = "pos", slice_rows: int = SLICE) -> DataFrame:
    """Repeats of an id become `id_1`, `id_2`, ... in the order of the whole number column `order`.

    Copies may be a large part of the rows, so no id is ranked in one task: rows are ranked inside
    slices of the order column (at most `slice_rows` each when it has no repeats) and a slice
    starts at the number of rows the earlier ones hold.
    """
    sliced = df.withColumn("__slice", F.floor(F.col(order) / F.lit(slice_rows)))
    inside = Window.partitionBy(key, "__slice").orderBy(order)
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(key, "__slice")
        .agg(F.count("*").alias("__n"))
        .select(key, "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
        .where("__start > 0")
    )
    nth = F.col("__rank") - 1 + F.coalesce("__start", F.lit(0))
    return (
        sliced.withColumn("__rank", F.row_number().over(inside))
        .join(starts, [key, "__slice"], "left")
        .withColumn(key, F.when(nth == 0, F.col(key)).otherwise(F.concat(key, F.lit("_"), nth)))
        .select(*df.columns)
    )


def distinct_mappings(field_mappings: DataFrame) -> DataFrame:
    """One row per (file, method, source field, target); the first in the file is kept.

    Map-side minimum per key, so copies are folded before the shuffle.
    """
    keys = ["file_path", "method", "source_field", "target_path", "target_field"]
    rest = [c for c in field_mappings.columns if c not in keys]
    first = F.min(F.struct("pos", *[c for c in rest if c != "pos"])).alias("__first")
    return (
        field_mappings.groupBy(*keys)
        .agg(first)
        .select(*keys, "__first.*")
        .select(*field_mappings.columns)
    )
