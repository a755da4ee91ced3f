"""Lineage questions as plain queries on field mappings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def by_types(field_mappings: DataFrame, source_type: str, target_type: str) -> DataFrame:
    """All mappings from one type to another."""
    return field_mappings.where(
        (F.col("source_type") == source_type) & (F.col("target_type") == target_type)
    )


def fields_between(field_mappings: DataFrame, source_type: str, target_type: str) -> DataFrame:
    """Which fields are mapped from one type to another."""
    return (
        by_types(field_mappings, source_type, target_type)
        .where(F.col("source_field").isNotNull())
        .select("source_field", "target_field")
        .distinct()
    )


def names_field(field: str) -> Column:
    """Whether a row has the field as a part of its source or target path, in any case."""
    part = rf"(?i)(?:^|[.\]]){re.escape(field)}(?:$|[.\[])"
    return F.col("source_field").rlike(part) | F.col("target_field").rlike(part)


def field_usage(field_mappings: DataFrame, sources: DataFrame, field: str) -> DataFrame:
    """Files whose text mentions a field, with the number of mappings that name it."""
    mentions = sources.where(F.col("content").rlike(rf"(?i)\b{re.escape(field)}\b"))
    counts = (
        field_mappings.where(names_field(field))
        .groupBy("file_path")
        .agg(F.count("*").alias("n_mappings"))
    )
    return (
        mentions.select("file_path").join(counts, "file_path", "left").fillna(0, ["n_mappings"])
    )


def transformed(field_mappings: DataFrame) -> DataFrame:
    """Mappings that rename a field or compute it."""
    return field_mappings.where(
        F.col("expression").isNotNull() | (F.col("source_field") != F.col("target_field"))
    )
