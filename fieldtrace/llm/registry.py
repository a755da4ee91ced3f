"""The queries of the operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldtrace.llm import (
    byte_bpe,
    divergence,
    hard_negatives,
    line_dedup,
    mixing,
    near_dup,
    quality_net,
    quality_rules,
    secrets,
    sentencepiece_viterbi,
    stream_dedup,
    token_files,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.query,
    "op2_secrets": secrets.query,
    "op3_stream_dedup": stream_dedup.query,
    "op4_sentencepiece": sentencepiece_viterbi.query,
    "op5_warc": warc.query,
    "op6_quality_net": quality_net.query,
    "op7_minhash_near_dup": near_dup.query,
    "op8_quality_rules": quality_rules.query,
    "op9_token_files": token_files.query,
    "op10_line_dedup": line_dedup.query,
    "op11_byte_bpe": byte_bpe.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_divergence": divergence.query,
}
ORACLES: dict[str, str] = {
    "op3_stream_dedup": stream_dedup.SQL,
    "op5_warc": warc.SQL,
    "op7_minhash_near_dup": near_dup.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_divergence": divergence.SQL,
}
