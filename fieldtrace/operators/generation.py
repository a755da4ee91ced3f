"""Text generation through a batch function, and what is made of its answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace import fixed

GenerateBatch = Callable[[list[tuple[str, str | None]]], list[str | None]]

MODEL_MAPPINGS = (
    "array<struct<mapping_type:string,source_type:string,target_type:string,method_name:string,"
    "field_mappings:array<struct<source_field:string,target_field:string,transformation:string>>>>"
)


def generate(
    prompts: DataFrame,
    make_generate: Callable[[], GenerateBatch],
    prompt_col: str = "prompt",
    system_col: str | None = None,
    out: str = "answer",
    concurrency: int | None = None,
    error_col: str | None = None,
    max_retries: int = 3,
    wait: float = 0.5,
) -> DataFrame:
    """Adds the answer to each prompt; null where the model gave none.

    `error_col` names a further column for the text of the error that a prompt failed with. A prompt
    that fails never takes others of its batch along: the batch is halved down to it, and it alone is
    tried `max_retries` times.
    """

    @F.pandas_udf("answer string, error string")
    def answers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = make_generate()
        for prompt, system in batches:
            got = each_alone(call, list(zip(prompt, system)), max_retries, wait)
            yield pd.DataFrame(got, columns=["answer", "error"], dtype=object)

    system = F.col(system_col) if system_col else F.lit(None).cast("string")
    if concurrency:
        prompts = prompts.repartition(concurrency)
    found = prompts.withColumn("__found", answers.asNondeterministic()(F.col(prompt_col), system))
    found = found.withColumn(out, F.col("__found.answer"))
    if error_col:
        found = found.withColumn(error_col, F.col("__found.error"))
    return found.drop("__found")


def each_alone(call, items: list, max_retries: int = 3, wait: float = 0.5) -> list[tuple]:
    """(result, error) of every item of a batch call, with errors kept to the items that cause them."""
    if not items:
        return []
    for attempt in range(max_retries if len(items) == 1 else 1):
        if attempt:
            time.sleep(wait * attempt)
        try:
            got = list(call(items))
            if len(got) != len(items):
                raise ValueError(f"{len(got)} results for {len(items)} items")
            return [(result, None) for result in got]
        except Exception as problem:
            error = f"{type(problem).__name__}: {problem}"
    if len(items) == 1:
        return [(None, error)]
    half = len(items) // 2
    return each_alone(call, items[:half], max_retries, wait) + each_alone(call, items[half:], max_retries, wait)


def describe_prompt(code, mapping: Column) -> Column:
    """Prompt for a description of one mapping; `mapping` is a struct."""
    return F.concat(
        F.lit(fixed.DESCRIBE_HEAD),
        F.col(code) if isinstance(code, str) else code,
        F.lit(fixed.DESCRIBE_MIDDLE),
        F.to_json(mapping, {"ignoreNullFields": "false"}),
        F.lit(fixed.DESCRIBE_TAIL),
    )


def extraction_prompt(code, max_chars: int | None = None) -> Column:
    """Prompt for extraction by the model over the whole code, or its first `max_chars` characters."""
    code = F.col(code) if isinstance(code, str) else code
    return F.concat(
        F.lit(fixed.EXTRACT_HEAD),
        code if max_chars is None else F.substring(code, 1, max_chars),
        F.lit(fixed.EXTRACT_TAIL),
    )


def parse_or_fallback(response, schema: str, fallback: Column) -> Column:
    """A JSON array, or one object as an array of one; the fallback where it is neither.

    `schema` is the array type. Null fields of an object do not make it broken.
    """
    response = F.col(response) if isinstance(response, str) else response
    item = schema[len("array<") : -1]
    text = F.trim(response)
    as_list = F.when(F.startswith(text, F.lit("[")), F.from_json(text, schema))
    as_item = F.when(
        F.startswith(text, F.lit("{")) & F.get_json_object(text, "$").isNotNull(),
        F.array(F.from_json(text, item)),
    )
    return F.coalesce(as_list, as_item, fallback)


def model_mappings(responses: DataFrame, response_col: str, fallback: Column) -> DataFrame:
    """Model answers as mapping lists with counts per kind; rule results where an answer is no JSON."""
    parsed = responses.withColumn(
        "mappings", parse_or_fallback(response_col, MODEL_MAPPINGS, fallback)
    )

    def kind(name: str) -> Column:
        return F.size(F.filter("mappings", lambda m: m["mapping_type"] == name))

    return parsed.select(
        "*",
        F.size("mappings").alias("total_mappings"),
        kind("mapstruct").alias("mapstruct_mappings"),
        kind("pojo").alias("pojo_mappings"),
    )
