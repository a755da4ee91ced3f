"""Result sinks: JSON lines with totals, and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldtrace.functions import text as tx
from fieldtrace.operators.progress import ingest_totals


def result_json(log: DataFrame) -> DataFrame:
    """One JSON object per file of the ingest log: stored with a summary, or failed with its error."""
    stored = F.to_json(
        F.struct("file", "status", F.struct("code_stored").alias("summary"))
    )
    failed = F.to_json(F.struct("error", "file"))
    return log.select("file", F.when(F.col("error").isNull(), stored).otherwise(failed).alias("json"))


def totals_json(log: DataFrame) -> DataFrame:
    """One JSON object with the totals of a run."""
    summary = F.struct(F.col("files_stored").alias("code_files_stored")).alias("summary")
    return ingest_totals(log).select(
        F.to_json(F.struct("files_processed", "files_stored", summary)).alias("json")
    )


def write_json(log: DataFrame, path: str) -> None:
    """`path/results` with a line per file, `path/totals` with one line."""
    result_json(log).select("json").write.mode("overwrite").text(f"{path}/results")
    totals_json(log).write.mode("overwrite").text(f"{path}/totals")


def write_text(reports: DataFrame, path: str) -> None:
    """Text reports of many files, one after the other."""
    reports.select(F.concat("report", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def result_line(log: DataFrame) -> DataFrame:
    """`File: f, Status: s` per file."""
    return log.select(
        "file",
        F.concat(
            F.lit("File: "), tx.default_text("file"), F.lit(", Status: "), tx.default_text("status")
        ).alias("line"),
    )
