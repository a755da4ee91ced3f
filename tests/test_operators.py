"""Operators on small tables, checked against plain Python."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldtrace import fixed
from fieldtrace.functions import text as tx
from fieldtrace.operators import chunking, dedup, embedding, generation, index, knn, progress


def test_chunks(spark):
    sizes = [0, 1, 1999, 2000, 2001, 4000]
    texts = [(f"f{n}.txt", "x" * n) for n in sizes] + [("e.txt", "a" * 1999 + "😀" + "b\n" * 700)]
    df = spark.createDataFrame(texts, "file_path string, content string")
    records = chunking.code_records(df)
    whole = {r["file_path"]: r["content"] for r in chunking.join_chunks(records).collect()}
    assert whole == {p: t for p, t in texts if t}
    counts = {r[0]: r[1] for r in records.groupBy("file_path").count().collect()}
    assert counts == {p: math.ceil(len(t) / 2000) for p, t in texts if t}
    short = records.where("file_path = 'f2000.txt'").first()
    assert (short["chunk_index"], short["total_chunks"]) == (None, None)
    assert records.where("file_path = 'e.txt' and chunk_index = 0").first()["document"][-1] == "😀"
    longest = max(len(t) for _, t in texts)
    assert chunking.chunk_texts(df, size=9000).agg(F.max(F.length("document"))).first()[0] == longest


def test_embed_input(spark):
    df = spark.createDataFrame([(n, "A" * n) for n in (999, 1000, 1001, 1999, 2000, 2001)], "n int, t string")
    lengths = rows(df.select("n", F.length(tx.embed_input("t")), F.length(tx.embed_retry_input("t"))))
    assert lengths == [
        (1000, 1000, 1000), (1001, 1001, 1020), (1999, 1999, 1020), (2000, 2000, 1020), (2001, 2034, 1020),
        (999, 999, 999),
    ]


def test_globs(spark):
    paths = ["a/target/G.java", "target/H.java", "a/src/test/Y.java", "a/FooTest.java", "a/X.java",
             "a\\build\\Z.java", "/abs/target/x/Q.java", "a/mytarget/R.java", "a/Testing.java"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    kept = [r[0] for r in df.where(~tx.excluded("p", fixed.EXCLUDE_PATTERNS)).collect()]
    assert kept == ["a/X.java", "a/mytarget/R.java", "a/Testing.java"]
    assert df.where(tx.excluded("p", ["**/a/*.java"])).count() == 3
    assert df.where(tx.excluded("p", ["X.java"])).count() == 1
    assert df.where(tx.excluded("p", [])).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("FirstName", "SPECIAL_NOTE_TYPE", "a/b.c/.hid"), ("x", "WORD", "q/w.tar.gz")],
        "a string, b string, p string",
    )
    got = rows(df.select(tx.decapitalise("a"), tx.snake_to_camel("b"), tx.basename("p"), tx.suffix("p")))
    assert got == [("firstName", "specialNoteType", ".hid", ""), ("x", "word", "w.tar.gz", ".gz")]


def test_hash_embed(spark):
    texts = [(1, "get name, get größe"), (2, "  ,;"), (3, None), (4, "x " * 5000)]
    out = embedding.hash_embed(spark.createDataFrame(texts, "id int, t string"), "t")
    got = {r["id"]: r["embedding"] for r in out.collect()}
    assert got[2] is None and got[3] is None
    assert len(got[1]) == 64 and sum(got[1]) == 4 and max(got[1]) >= 2
    assert sum(got[4]) == 5000
    assert rows(embedding.embedded_only(out), "id") == [(1,), (4,)]


def test_hash_embed_looks_at_repeated_words_once(monkeypatch):
    seen, split = [], embedding.pc.split_pattern_regex
    monkeypatch.setattr(embedding.pc, "split_pattern_regex", lambda a, **kw: seen.append(len(a)) or split(a, **kw))
    got = embedding.count_buckets(embedding.pa.array(["größe—x, get é·; ", None, "— ·"] * 50), 64).to_pylist()
    want = [0] * 64
    for word in ("größe", "x", "get", "é"):
        want[embedding._hash32(word) % 64] += 1
    assert got[:3] == [want, None, None] and got[-3:] == got[:3] and sum(seen) <= 4


def test_embed_retries():
    calls = []

    def embed(texts):
        calls.append([len(t) for t in texts])
        if max(len(t) for t in texts) > 1500:
            raise ValueError("input too long")
        return [[1.0] if "ok" in t else None for t in texts]

    out = embedding.with_retries(embed, ["ok", " ", None, "no", "ok" * 1000], wait=0)
    assert out == [[1.0], None, None, None, [1.0]]
    assert calls == [[2, 2, 2000], [2], [2, 2000], [2], [2000], [1020], [2], [2]]


def test_texts_without_words_leave_other_vectors_alone():
    import pyarrow as pa

    found = embedding.count_buckets(pa.array(["a b", "", "c", None, " . ", "d"]), 8)
    assert [v and len(v) for v in found.to_pylist()] == [8, None, 8, None, None, 8]


def test_a_vector_never_depends_on_its_neighbours():
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t))] for t in texts]

    good = ["x" * n for n in (1, 1500, 3000)]
    alone = [embedding.with_retries(embed, [t], wait=0)[0] for t in good]
    beside = embedding.with_retries(embed, [good[0], "bad", good[1], "bad" * 600, good[2]], wait=0)
    assert [beside[0], beside[2], beside[4]] == alone and beside[1] is None and beside[3] is None


def test_model_answers(spark):
    lines = ['[{"mapping_type": "pojo"}, {"mapping_type": "mapstruct"}]', '{"mapping_type": "pojo"}',
             "no JSON", None, '{"mapping_type": ']
    df = spark.createDataFrame(list(enumerate(lines)), "id int, answer string")
    fallback = F.array().cast(generation.MODEL_MAPPINGS)
    out = generation.model_mappings(df, "answer", fallback)
    got = rows(out, "id", "total_mappings", "mapstruct_mappings", "pojo_mappings")
    assert got == [(0, 2, 1, 1), (1, 1, 0, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0)]


def test_failing_generator(spark):
    def make():
        def call(pairs):
            raise RuntimeError("down")

        return call

    df = spark.createDataFrame([("p",)], "prompt string")
    found = generation.generate(df, make, error_col="error", wait=0.0).first()
    assert (found["answer"], found["error"]) == (None, "RuntimeError: down")


def test_unique_ids_with_hot_id(spark):
    """A third of the rows share an id; ranks hold across slices."""
    random.seed(1)
    data = [("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(3000)]
    random.shuffle(data)
    out = dedup.unique_ids(spark.createDataFrame(data, "id string, pos long"), slice_rows=100)
    seen, want = {}, []
    for key, pos in sorted(data, key=lambda d: d[1]):
        n = seen[key] = seen.get(key, -1) + 1
        want.append((f"{key}_{n}" if n else key, pos))
    assert rows(out) == sorted(want, key=repr)


def test_insert_if_absent_twice(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    old = spark.createDataFrame([("b", 9), ("b", 8)], "id string, v int")
    first = dedup.insert_if_absent(new, old)
    assert rows(first) == [("a", 1)]
    assert dedup.insert_if_absent(new, old.unionByName(first)).count() == 0


def test_distinct_mappings_keeps_first(spark):
    schema = "file_path string, method string, source_field string, target_path string, target_field string, pos int, type string"
    data = [("f", "m", "a", None, "b", p, "pojo") for p in (5, 3, 9)] + [("f", "m", "a", "x", "b", 1, "pojo")]
    out = dedup.distinct_mappings(spark.createDataFrame(data, schema))
    assert rows(out, "target_path", "pos") == [("x", 1), (None, 3)]


def test_batch_progress(spark):
    files = spark.createDataFrame([(f"f{i}",) for i in range(2500)], "file_path string")
    got = rows(progress.batch_progress(files))
    assert got == [(0, 1000, 1000, 40.0, True), (1, 1000, 2000, 80.0, True), (2, 500, 2500, 100.0, True)]
    positions = sorted(r["position"] for r in progress.file_positions(files).collect())
    assert positions == list(range(2500))


def brute(vectors, queries, k, metric):
    out = []
    for q, a in queries:
        ds = []
        for i, b in vectors:
            a64, b64 = np.array(a, float), np.array(b, float)
            if metric == "cosine":
                norm = np.linalg.norm(a64) * np.linalg.norm(b64)
                d = 1 - (a64 @ b64 / norm if norm else 0)
            else:
                d = ((a64 - b64) ** 2).sum()
            ds.append((round(d, 6) + 0.0, i))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(ds)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    """Whole numbers, so ties are exact; a third are copies of one vector, one is zero."""
    rng = np.random.default_rng(3)
    data = [(f"v{i:03}", [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(300)]
    copies = [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0]) if n % 3 == 0 else (i, v) for n, (i, v) in enumerate(data)]
    return copies + [("zero", [0.0] * 8)]


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_nearest_is_exact(spark, vectors, metric):
    queries = [(n, v) for n, (_, v) in enumerate(vectors[::10])]
    table = spark.createDataFrame(vectors, "id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id int, embedding array<float>")
    want = brute(vectors, queries, 7, metric)
    scan = knn.nearest(table, asked, 7, metric=metric)
    grid = knn.nearest(table, asked, 7, metric=metric, scan_bytes=8)
    small = knn.grid_join(table, asked, 7, metric, slice_rows=40)
    for hits in (scan, grid, small):
        assert rows(hits, "query_id", "id", "rank") == want


def test_approximate_recall(spark, vectors):
    table = spark.createDataFrame(vectors, "id string, embedding array<float>")
    asked = table.withColumnRenamed("id", "query_id")
    exact = knn.nearest(table, asked, 5)
    assert knn.recall(knn.nearest_approx(table, asked, 5, bits=0), exact).first()["recall"] == 1.0
    partly = knn.nearest_approx(table, asked, 5, bits=3, slice_rows=50)
    assert knn.recall(partly, exact).first()["recall"] > 0.7


def test_slices_of_queries_pass_on_k_hits(spark, vectors, monkeypatch):
    """However many slices the rows would have, each query gives `k` hits to the ranking."""
    monkeypatch.setattr(knn, "_ranked", lambda hits, k: hits)
    table = spark.createDataFrame(vectors, "id string, embedding array<float>")
    asked = table.withColumnRenamed("id", "query_id")
    assert knn.grid_join(table, asked, 3, slice_rows=10).count() == 3 * len(vectors)
    assert knn.nearest_approx(table, asked, 3, bits=2, slice_rows=10).count() <= 3 * len(vectors)


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_cells_are_exact(spark, vectors, metric):
    # Narrow groups, whose far cells can be ruled out; zero vectors, and query ids that are there twice or null.
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 8))
    close = [(f"w{i:03}", [float(x) for x in middles[i % 12] + rng.normal(size=8) / 50]) for i in range(240)]
    data = vectors + close + [("zero2", [0.0] * 8)]
    queries = [(None if n == 7 else n // 2 if n < 20 else n, v) for n, (_, v) in enumerate(data[::9])]
    table = spark.createDataFrame(data, "id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([*queries, (990, [0.0] * 8)], "query_id int, embedding array<float>")
    got = knn.nearest_cells(table, asked, 7, metric=metric, bits=6, slice_rows=20)
    want = knn.nearest(table, asked, 7, metric=metric)
    assert rows(got, "query_id", "id", "distance", "rank") == rows(want, "query_id", "id", "distance", "rank")


def test_index_reads_few_vectors_and_misses_none(spark):
    found = entry.queries()["knn_recall"](spark, "/root/testdata/sf0.1").first()
    assert found["n_exact"] >= 400 and found["recall_reached"] and found["few_vectors_read"]


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_index_is_exact(spark, vectors, metric, tmp_path):
    rng = np.random.default_rng(6)
    close = [(f"w{i:03}", [float(x) for x in rng.normal(size=8) / 9 + i % 5]) for i in range(300)]
    data = [*vectors, *close, *[(f"z{i}", [0.0] * 8) for i in range(3)], *[(f"t{i}", close[0][1]) for i in range(40)]]
    table = spark.createDataFrame([*data, ("none", None)], "id string, embedding array<float>").repartition(4)
    queries = [(None if n == 7 else n // 2, v) for n, (_, v) in enumerate(data[::7])]
    asked = spark.createDataFrame([*queries, (990, [0.0] * 8)], "query_id int, embedding array<float>")
    made = index.train(table, str(tmp_path / "index"), metric, partitions=9, code_bytes=3, sample_rows=200)
    made.add(table.where("id < 'v'"))
    made.add(table.where("id >= 'v'"))
    want = rows(knn.nearest(table, asked, 6, metric=metric), "query_id", "id", "distance", "rank")
    again = index.Index(spark, str(tmp_path / "index"))
    for probes, scan_bytes in ((1, 1 << 20), (9, 1 << 20), (2, 2000)):
        got = again.search(asked, 6, probes=probes, scan_bytes=scan_bytes)
        if scan_bytes > 2000:
            assert rows(got, "query_id", "id", "distance", "rank") == want
        else:
            assert got.count() == len(want)
    partly = again.search(asked, 6, probes=2, exact=False)
    assert partly.where("rank = 1").count() > 0
    assert again.search(asked.limit(0), 6).count() == 0


def test_index_keeps_no_pairs(spark, vectors, monkeypatch, tmp_path):
    """Pairs of queries and rows never become rows: tasks pass on `k` rows of each query at most."""
    table = spark.createDataFrame(vectors, "id string, embedding array<float>").repartition(2)
    asked = table.withColumnRenamed("id", "query_id")
    made = index.train(table, str(tmp_path / "index"), partitions=4, code_bytes=2)
    made.add(table)
    real, held = index.hold, []
    monkeypatch.setattr(index, "hold", lambda df: held.append(df) or real(df))
    got = made.search(asked, 3)
    assert rows(got) == rows(knn.nearest(table, asked, 3), *got.columns)
    assert [df.columns for df in held] == [["query_id", "embedding", "q"]]


def test_nearest_bounds(spark, vectors):
    table = spark.createDataFrame(vectors, "id string, embedding array<float>")
    asked = table.limit(0).withColumnRenamed("id", "query_id")
    with pytest.raises(ValueError):
        knn.nearest(table, asked, 0)
    odd = spark.createDataFrame([("odd", [1.0, 2.0])], "id string, embedding array<float>")
    first = table.limit(1).withColumnRenamed("id", "query_id")
    with pytest.raises(Exception, match="vectors of"):
        knn.nearest(table.unionByName(odd), first, 3).collect()
    assert knn.nearest(table, asked, 5).count() == 0
    one = table.where("id = 'v001'").withColumnRenamed("id", "query_id")
    assert knn.nearest(table, one, 20, where={"id": "v002"}).count() == 1
    assert knn.nearest(table, one, 30).count() == min(30, len(vectors))


def test_a_model_is_asked_once_per_question(spark, vectors):
    table = spark.createDataFrame(vectors, "id string, embedding array<float>")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def model(name):
        calls.add(1)
        return [float(len(name))] * len(vectors[0][1])

    asked = spark.createDataFrame([(f"q{i}",) for i in range(7)], "query_id string")
    knn.nearest(table, asked.withColumn("embedding", model.asNondeterministic()("query_id")), 3).collect()
    assert calls.value == 7
