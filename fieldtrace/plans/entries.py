"""Mapping entries (one per annotation or method), their ids, texts and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace import fixed
from fieldtrace.functions import text as tx
from fieldtrace.session import hold

ENTRY_KEYS = ["file_path", "type", "interface", "method", "source_type", "target_type"]


def complete(field_mappings: DataFrame) -> DataFrame:
    """Rows with source and target field, and implicit mappings."""
    both = tx.filled("source_field").isNotNull() & tx.filled("target_field").isNotNull()
    return field_mappings.where(both | F.col("implicit"))


def normalised_fields(df: DataFrame) -> DataFrame:
    """`source`/`target` keys folded into `source_field`/`target_field`; empty texts become null."""
    return df.withColumn(
        "source_field", tx.first_filled("source_field", "source")
    ).withColumn("target_field", tx.first_filled("target_field", "target"))


def _field() -> Column:
    # Keys in sorted order: the id of an entry is made of them.
    return F.struct(
        tx.filled("expression").alias("expression"),
        F.col("ignore"),
        tx.first_filled("source_field").alias("source_field"),
        tx.first_filled("target_field").alias("target_field"),
        tx.filled("target_path").alias("target_path"),
    )


def entries(field_mappings: DataFrame) -> DataFrame:
    """One entry per annotation, implicit method or hand-written method, with its field mappings.

    Ignored targets are kept with the flag set; other annotations need a source field. Mappings are read once
    and grouped within their file, so extracted ones stay in the tasks that extracted them.
    """
    both = tx.filled("source_field").isNotNull() & tx.filled("target_field").isNotNull()
    kept = field_mappings.where(both | F.col("implicit") | F.col("ignore"))
    no_fields = F.array().cast(f"array<{_FIELD_TYPE}>")
    found = F.struct("pos", "target_field", _field().alias("f"), "implicit")
    ordered = F.array_sort(F.collect_list(found))
    declared = F.transform(
        "found",
        lambda p: F.struct(
            F.when(p["implicit"], no_fields).otherwise(F.array(p["f"])).alias("field_mappings"),
            p["implicit"].alias("implicit"),
            p["pos"].alias("pos"),
        ),
    )
    written = F.struct(
        F.transform("found", lambda p: p["f"]).alias("field_mappings"),
        F.lit(False).alias("implicit"),
        F.col("method_pos").alias("pos"),
    )
    return (
        kept.where(F.col("type").isin("mapstruct", "pojo"))
        .groupBy(*ENTRY_KEYS, "method_pos")
        .agg(ordered.alias("found"))
        .withColumn("e", F.explode(F.when(F.col("type") == "mapstruct", declared).otherwise(F.array(written))))
        .select(*ENTRY_KEYS, "e.*")
    )


_FIELD_TYPE = (
    "struct<expression:string,ignore:boolean,source_field:string,target_field:string,"
    "target_path:string>"
)


def grouped(field_mappings: DataFrame) -> DataFrame:
    """One entry per method with all its annotations in order."""
    ordered = F.array_sort(
        F.collect_list(F.struct("pos", tx.first_filled("source_field").alias("source"),
                                tx.first_filled("target_field").alias("target")))
    )
    return (
        field_mappings.where(F.col("type") == "mapstruct")
        .groupBy("file_path", "interface", "method", "source_type", "target_type", "method_pos")
        .agg(
            F.transform(ordered, lambda p: F.struct(p["source"], p["target"])).alias("fields"),
            F.bool_or("implicit").alias("implicit"),
        )
        .withColumn("n_fields", F.when(F.col("implicit"), 0).otherwise(F.size("fields")))
    )


def canonical_json(entry_fields: Column | str = "field_mappings") -> Column:
    """The mapping as JSON with nine keys in sorted order; missing names count as empty."""
    fields = F.col(entry_fields) if isinstance(entry_fields, str) else entry_fields
    keep_nulls = {"ignoreNullFields": "false"}
    listed = F.when(F.size(fields) > 0, F.to_json(fields, keep_nulls)).otherwise("")
    single = F.lit("")
    return F.to_json(
        F.struct(
            listed.alias("fields"),
            F.col("file_path").alias("file"),
            tx.default_text("interface", "").alias("interface"),
            tx.default_text("method", "").alias("method"),
            single.alias("source_field"),
            F.col("source_type"),
            single.alias("target_field"),
            F.col("target_type"),
            F.col("type"),
        ),
        keep_nulls,
    )


def with_id(entry_rows: DataFrame) -> DataFrame:
    return entry_rows.withColumn("id", F.md5(canonical_json()))


def _named(label: str, c) -> Column:
    """`label value`, or null where there is no value."""
    return F.concat(F.lit(label), tx.filled(c))


def _field_lines(indent: str, deeper: str, flags: bool) -> Column:
    def line(f: Column) -> Column:
        ignored = F.when(F.lit(flags) & f["ignore"], F.lit(f"\n{deeper}(IGNORED)")).otherwise("")
        return F.concat(
            F.lit(indent),
            F.coalesce(tx.filled(f["source_field"]), F.lit("N/A")),
            F.lit(" -> "),
            F.coalesce(tx.filled(f["target_field"]), F.lit("N/A")),
            F.coalesce(F.concat(F.lit(f"\n{deeper}Expression: "), f["expression"]), F.lit("")),
            ignored,
        )

    return F.array_join(F.transform("field_mappings", line), "\n")


def _if_fields(head: str, lines: Column) -> Column:
    return F.when(F.size("field_mappings") > 0, F.concat(F.lit(head + "\n"), lines))


def snippet(code: Column) -> Column:
    """The last part of a mapping's text, null where there is no code."""
    return F.concat(F.lit("\nCode:\n"), tx.filled(code))


def document(code: Column | None = None) -> Column:
    """The text a mapping is stored under, with all of `code` behind it."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Mapping Type: "), tx.default_text("type", "unknown")),
        F.concat(F.lit("Source Type: "), tx.default_text("source_type")),
        F.concat(F.lit("Target Type: "), tx.default_text("target_type")),
        _named("Interface: ", "interface"),
        _named("Method: ", "method"),
        _if_fields("Field Mappings:", _field_lines("  ", "    ", False)),
        snippet(code) if code is not None else F.lit(None).cast("string"),
    )


def context_text(number) -> Column:
    """A mapping in the context of a question."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("\n--- Mapping "), F.col(number).cast("string"), F.lit(" ---")),
        F.concat(F.lit("Type: "), tx.default_text("type")),
        F.concat(
            F.lit("Source: "), tx.default_text("source_type"),
            F.lit(" -> Target: "), tx.default_text("target_type"),
        ),
        _named("Method: ", "method"),
        _if_fields(
            "Field Mappings:",
            F.array_join(
                F.transform(
                    "field_mappings",
                    lambda f: F.concat(
                        F.lit("  "), F.coalesce(tx.filled(f["source_field"]), F.lit("N/A")),
                        F.lit(" -> "), F.coalesce(tx.filled(f["target_field"]), F.lit("N/A")),
                    ),
                ),
                "\n",
            ),
        ),
        F.lit(""),
    )


def report_text(number) -> Column:
    """A mapping in the text report of its file."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Mapping "), F.col(number).cast("string"), F.lit(": "), F.upper("type")),
        F.concat(F.lit("  Source Type: "), tx.default_text("source_type")),
        F.concat(F.lit("  Target Type: "), tx.default_text("target_type")),
        _named("  Interface: ", "interface"),
        _named("  Method: ", "method"),
        _if_fields("  Field Mappings:", _field_lines("    ", "      ", True)),
        F.when(
            (F.size("field_mappings") == 0) & F.col("implicit"),
            F.lit("  Implicit mapping (field names match)"),
        ),
        F.lit(""),
    )


def _counts() -> list[Column]:
    return [
        F.count("*").alias("total_mappings"),
        F.count_if(F.col("type") == "mapstruct").alias("mapstruct_mappings"),
        F.count_if(F.col("type") == "pojo").alias("pojo_mappings"),
    ]


COUNTS = ["total_mappings", "mapstruct_mappings", "pojo_mappings"]


def summary(files: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """Per file: mappings in all and per kind, zero where there are none; its read error if any."""
    counts = entry_rows.groupBy("file_path").agg(*_counts())
    error = ["error"] if "error" in files.columns else []
    return (
        files.select("file_path", *error).join(counts, "file_path", "left").fillna(0, COUNTS)
    )


def fields_per_mapping(entry_rows: DataFrame) -> DataFrame:
    return entry_rows.select(
        "file_path", "type", "method", "pos", F.size("field_mappings").alias("n_fields")
    )


def sample_diagnostic(
    sources: DataFrame, extract: Callable[[DataFrame], DataFrame], n: int = 5
) -> DataFrame:
    """Over the first `n` files by path: files, files with mappings, mappings.

    `extract(sources)` gives entries; only the sample goes through it.
    """
    sample = hold(sources.orderBy("file_path").limit(n))
    return summary(sample, extract(sample)).agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("total_mappings") > 0).alias("files_with_mappings"),
        F.sum("total_mappings").alias("total_mappings"),
    )


def text_report(files: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """`(file_path, report)`: the readable report of each file. Entries are read once."""
    ordered = F.array_sort(
        F.collect_list(F.struct("pos", F.struct(*ENTRY_KEYS, "field_mappings", "implicit").alias("e")))
    )
    numbered = (
        entry_rows.groupBy("file_path")
        .agg(ordered.alias("all"), *_counts())
        .select(*COUNTS, F.posexplode("all").alias("i", "p"))
        .select(*COUNTS, (F.col("i") + 1).alias("number"), "p.e.*")
    )
    bodies = (
        numbered.select(
            "file_path", *COUNTS, F.struct("number", report_text("number").alias("t")).alias("b")
        )
        .groupBy("file_path", *COUNTS)
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list("b")), lambda b: b["t"]), "\n"
            ).alias("body")
        )
    )

    def counted(label: str, c: str) -> Column:
        return F.concat(F.lit(label), F.col(c).cast("string"))

    return (
        files.select("file_path")
        .join(bodies, "file_path", "left")
        .fillna(0, COUNTS)
        .select(
            "file_path",
            F.concat_ws(
                "\n",
                F.concat(F.lit("File: "), F.col("file_path")),
                counted("Total Mappings: ", "total_mappings"),
                counted("  - MapStruct: ", "mapstruct_mappings"),
                counted("  - POJO: ", "pojo_mappings"),
                F.lit(""),
                "body",
            ).alias("report"),
        )
    )
