"""A corpus made ready for training: low quality out, shared lines out, near copies out, sources mixed,
texts as token ids. Each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.llm import line_dedup, mixing, near_dup, quality_net, sentencepiece_viterbi
from fieldtrace.llm.common import small_batches, table, written
from fieldtrace.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    small_batches(spark)
    net = quality_net.train(docs, table(spark, sf_dir, "labels"))
    score = "score"
    while score in [c.lower() for c in docs.columns]:
        score += "_"
    kept = quality_net.classify(docs, net, score_col=score).where(F.col(score) >= quality_net.KEEP)
    return kept.drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text."""
    small_batches(spark)
    found = line_dedup.drop_lines(docs).select(*docs.columns)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    small_batches(spark)
    groups = near_dup.near_duplicates(docs)
    lost = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    small_batches(spark)
    return sentencepiece_viterbi.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_net", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
# The classifier's learned numbers have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next one reads it."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
