"""Mappings of source files by rules, or by a model with the rules behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fieldtrace.operators import generation
from fieldtrace.plans import entries as en, lineage

MODES = ("rules", "model")


def rule_mappings(sources: DataFrame) -> DataFrame:
    """`(file_path, rules)`: each file's entries in the form that a model answers in."""
    entry = F.struct(
        F.col("type").alias("mapping_type"),
        "source_type",
        "target_type",
        F.col("method").alias("method_name"),
        F.transform(
            "field_mappings",
            lambda f: F.struct(
                f["source_field"].alias("source_field"),
                f["target_field"].alias("target_field"),
                f["expression"].alias("transformation"),
            ),
        ).alias("field_mappings"),
    )
    rows = en.entries(lineage.field_mappings(sources))
    ordered = F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry"))))
    return rows.groupBy("file_path").agg(F.transform(ordered, lambda p: p["entry"]).alias("rules"))


def extract(
    sources: DataFrame,
    mode: str = "rules",
    make_generate: Callable[[], generation.GenerateBatch] | None = None,
    max_chars: int | None = None,
    max_retries: int = 3,
    wait: float = 0.5,
) -> DataFrame:
    """One row per file: file_path, mappings, their counts in all and per kind, and error.

    `mode="model"` asks the model about the whole code (or its first `max_chars` characters) of each
    file; where its answer is no JSON, or an error, the mappings are those of the rules.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    none = F.array().cast(generation.MODEL_MAPPINGS)
    rows = sources.select("file_path", "content").join(rule_mappings(sources), "file_path", "left")
    rows = rows.withColumn("rules", F.coalesce(F.col("rules").cast(generation.MODEL_MAPPINGS), none))
    if mode == "rules":
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    else:
        prompt = generation.extraction_prompt("content", max_chars)
        rows = generation.generate(
            rows.withColumn("prompt", prompt), make_generate, error_col="error",
            max_retries=max_retries, wait=wait,
        )
    found = generation.model_mappings(rows, "answer", F.col("rules"))
    return found.select(
        "file_path", "mappings", "total_mappings", "mapstruct_mappings", "pojo_mappings", "error"
    )
