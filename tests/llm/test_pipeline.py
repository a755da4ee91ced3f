"""The pipeline stage by stage against brute force, and the registered queries against their SQL."""

import re
import tracemalloc

import pyarrow as pa
import pytest

import corpus_pipeline as cp
import odd
from checks import compare
from fieldtrace.llm import common, line_dedup, quality_net, registry, sentencepiece_viterbi, shingles
from test_line_dedup import brute as lines_brute
from test_near_dup import brute as near_brute

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "work",
    [quality_net.Net.new().scores, lambda t: line_dedup.Lines(t, 40), lambda t: shingles.shingle_sets(t, 5)],
)
def test_memory_of_a_block(work):
    """What a Python worker takes beside the batch is bounded, as two of them share an executor with its heap."""
    batch = pa.record_batch({"text": ["some words of a text\nand a line " * 100] * 700})
    tracemalloc.start()
    for _, texts in common.blocks(iter([batch]), "text"):
        work(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents before, between and after all stages."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in cp.STAGES:
        stage(spark, docs[-1], SMALL).write.parquet(f"{folder}/{name}")
        docs.append(spark.read.parquet(f"{folder}/{name}"))
    return docs


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_columns(stages):
    assert all(set(d.columns) == set(stages[0].columns) for d in stages[1:5])
    assert {"doc_id", "ids", "n_tokens"} <= set(stages[5].columns)


def test_quality(spark, stages):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r[0] for r in rows(stages[1])}
    assert {r[0] for r in rows(stages[0])} > kept
    good = [i for i, q in label.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, q in label.items() if q == 0) <= 0.4 * sum(q == 0 for q in label.values())


def test_lines(stages):
    want = {(i, t) for i, t, _, _ in lines_brute(rows(stages[1]))}
    assert {(i, t) for i, t, _ in rows(stages[2])} == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_copies(stages):
    kept = {r[0] for r in near_brute(rows(stages[2]), 80) if r[3]}
    assert {r[0] for r in rows(stages[3])} == kept


def test_mixing(stages):
    before, after = rows(stages[3]), rows(stages[4])
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    assert set(after) <= set(before)
    total = sum(size(r[1]) for r in before)
    assert abs(sum(size(r[1]) for r in after) - total) < 0.1 * total


def test_encoding(stages):
    vocab = sentencepiece_viterbi.vocabulary()
    for row in stages[5].collect():
        assert vocab.decode(row.ids, [len(row.ids)])[0].decode() == row.text
    assert stages[5].count() == stages[4].count()


def test_odd_tables(spark, tmp_path):
    """Every stage over odd rows and over no rows."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, docs in (("odd", odd.frame(spark)), ("none", odd.empty(spark))):
        docs = docs.select(*columns)
        for stage, function in cp.STAGES:
            path = str(tmp_path / f"{name}-{stage}")
            function(spark, docs, SMALL).write.parquet(path)
            docs = spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert compare.compare(spark, compare.duck(SMALL), name, SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_give_a_row_per_document(spark, name):
    found = registry.QUERIES[name](spark, SMALL)
    assert found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
