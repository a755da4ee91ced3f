"""Context, prompt and answer for many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtrace import fixed
from fieldtrace.functions import text as tx
from fieldtrace.operators import chunking, generation, knn
from fieldtrace.plans import entries as en, lineage
from fieldtrace.session import hold, small


def _joined(rows: DataFrame, head: str, order: str, name: str) -> DataFrame:
    """Texts of each question in order under a heading; at most `k` hits' worth per question."""
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct(order, "text"))), lambda t: t["text"]
    )
    return rows.groupBy("query_id").agg(
        F.concat(F.lit(head + "\n"), F.array_join(texts, "\n")).alias(name)
    )


def _head(label: str) -> Column:
    return F.concat(
        F.lit(f"\n--- {label} "),
        F.col("rank").cast("string"),
        F.lit(" (Similarity: "),
        tx.percent_text(knn.similarity()),
        F.lit(") ---"),
    )


def code_section(hits: DataFrame, code: DataFrame) -> DataFrame:
    """Retrieved code per question. `code` has `id, file_path, chunk_index, total_chunks, document`."""
    chunk = F.concat(
        F.lit("Chunk: "),
        (F.col("chunk_index") + 1).cast("string"),
        F.lit("/"),
        tx.default_text(F.col("total_chunks").cast("string"), "?"),
    )
    text = F.concat_ws(
        "\n",
        _head("Code File"),
        F.concat(F.lit("File: "), tx.default_text("file_path")),
        chunk,
        F.concat(F.lit("\nFull Code:\n"), tx.default_text("document", "")),
        F.lit(""),
    )
    found = _with_records(hits, code)
    return _joined(found.withColumn("text", text), fixed.CODE_SECTION, "rank", "code_section")


def stored_section(hits: DataFrame, mappings: DataFrame) -> DataFrame:
    """Retrieved mapping records per question."""
    text = F.concat_ws(
        "\n",
        _head("Mapping"),
        F.concat(F.lit("File: "), tx.default_text("file_path")),
        F.concat(F.lit("Type: "), tx.default_text("mapping_type")),
        F.concat(
            F.lit("Source: "), tx.default_text("source_type"),
            F.lit(" -> Target: "), tx.default_text("target_type"),
        ),
        F.concat(F.lit("Interface: "), tx.filled("interface")),
        F.concat(F.lit("Method: "), tx.filled("method")),
        F.concat(F.lit("\nDetails:\n"), tx.default_text("document", "")),
        F.lit(""),
    )
    found = _with_records(hits, mappings)
    return _joined(found.withColumn("text", text), fixed.STORED_SECTION, "rank", "stored_section")


def _with_records(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Held hits with their texts: texts are kept out of the distance stage and joined here."""
    return records.join(small(hits).select("query_id", "rank", "id", "distance"), "id")


def extract_on_hits(hits: DataFrame, code: DataFrame) -> DataFrame:
    """Mapping entries of the files that were hit, per question, in the order of the hits.

    All chunks of a hit file are joined first, so a method cut by a chunk border is found. A file
    is extracted once however many questions hit it. `hits` are held.
    """
    files = hold(
        code.select("id", "file_path")
        .join(small(hits).select("query_id", "rank", "id"), "id")
        .groupBy("query_id", "file_path")
        .agg(F.min("rank").alias("rank"))
    )
    texts = chunking.join_chunks(code.join(small(files), "file_path", "left_semi"))
    found = en.entries(lineage.field_mappings(texts))
    return found.join(files, "file_path")


def extracted_section(extracted: DataFrame) -> DataFrame:
    in_order = Window.partitionBy("query_id").orderBy("rank", "file_path", "pos")
    numbered = extracted.withColumn("number", F.row_number().over(in_order))
    return _joined(
        numbered.withColumn("text", en.context_text("number")),
        fixed.EXTRACTED_SECTION,
        "number",
        "extracted_section",
    )


def build_context(
    questions: DataFrame,
    code_hits: DataFrame | None,
    code: DataFrame | None,
    mapping_hits: DataFrame | None,
    mappings: DataFrame | None,
    extract: bool = True,
) -> DataFrame:
    """`questions` with the column `context`; a fixed text where nothing was retrieved.

    Hits are held tables: several sections read them.
    """
    sections = []
    if code_hits is not None:
        sections.append(code_section(code_hits, code))
        if extract:
            sections.append(extracted_section(extract_on_hits(code_hits, code)))
    if mapping_hits is not None:
        sections.append(stored_section(mapping_hits, mappings))
    out, names = questions, [s.columns[1] for s in sections]
    for section in sections:
        out = out.join(section, "query_id", "left")
    context = F.concat_ws("\n", *names) if names else F.lit("")
    return out.withColumn(
        "context", tx.first_filled(context, default=fixed.EMPTY_CONTEXT)
    ).drop(*names)


def with_prompt(questions: DataFrame) -> DataFrame:
    """Adds `prompt` and `system` from `question` and `context`."""
    return questions.withColumn(
        "prompt",
        F.concat(
            F.lit(fixed.PROMPT_HEAD),
            F.col("question"),
            F.lit("\n\n"),
            F.col("context"),
            F.lit(fixed.PROMPT_TAIL),
        ),
    ).withColumn("system", F.lit(fixed.SYSTEM_PROMPT))


def _retrievals(hits: DataFrame, name: str) -> DataFrame:
    hit = F.struct("rank", "id", "distance")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias(name))


def answer_questions(
    questions: DataFrame,
    code: DataFrame,
    mappings: DataFrame | None,
    embed: Callable[[DataFrame, str], DataFrame],
    make_generate: Callable[[], generation.GenerateBatch],
    k: int = fixed.DEFAULT_RESULTS,
    use_full_code: bool = True,
    extract: bool = True,
    metric: str = "cosine",
) -> DataFrame:
    """Answers for a table `(query_id, question)`: retrieval, context, prompt, generation.

    `embed(df, text_col)` adds `embedding`. A question without vector or without answer gets its
    text in `error`.
    """
    # Vectors and hits are read by several steps: the model is asked and the tables are searched once.
    asked = hold(embed(questions.select("query_id", "question"), "question"))
    usable = asked.where(F.col("embedding").isNotNull())
    code_hits = mapping_hits = None
    if use_full_code:
        code_hits = hold(knn.nearest(code, usable, k, metric=metric))
    if mappings is not None:
        mapping_hits = hold(knn.nearest(mappings, usable, k, metric=metric))
    found = build_context(
        usable.select("query_id", "question"), code_hits, code, mapping_hits, mappings, extract
    )
    answered = generation.generate(with_prompt(found), make_generate, system_col="system")
    out = asked.join(answered.drop("question"), "query_id", "left")
    for hits, name in ((mapping_hits, "retrievals"), (code_hits, "code_retrievals")):
        if hits is not None:
            out = out.join(_retrievals(hits, name), "query_id", "left")
    error = F.when(F.col("embedding").isNull(), fixed.NO_EMBEDDING_ERROR).when(
        tx.filled("answer").isNull(), fixed.NO_ANSWER_ERROR
    )
    kept = [c for c in ("retrievals", "code_retrievals") if c in out.columns]
    return out.select(
        "query_id",
        "question",
        *kept,
        tx.default_text("context", "").alias("context"),
        tx.default_text("answer", "").alias("answer"),
        error.alias("error"),
    )
