"""Questions to answers, and the streams."""

import json
import os

import pytest
from conftest import rows
from java import FLEET, NESTED
from pyspark.sql import functions as F

from fieldtrace import fixed
from fieldtrace.operators import embedding, knn
from fieldtrace.plans import extraction, ingest, rag, search
from fieldtrace.sources import store as st
from fieldtrace.streaming import answer_log, answers, changes, gathering, ingest as stream


def embed(df, text_col):
    return embedding.hash_embed(df, text_col)


def test_answers(spark, tmp_path):
    def make_generate():
        return lambda pairs: ["" if "silent" in p else f"{s[:15]}/{len(p)}" for p, s in pairs]

    store = st.Store(spark, str(tmp_path / "store"))
    # The method of the second file is cut by a chunk border.
    texts = [("a.java", FLEET), ("b.java", "/* " + "z " * 900 + "*/" + NESTED)]
    ingest.ingest(store, spark.createDataFrame(texts, "file_path string, content string"), embed, with_mappings=True)
    questions = [(1, "How does the card of a truck get depot.name from home?"), (2, " ?"), (3, "silent order notes")]
    asked = spark.createDataFrame(questions, "query_id int, question string")
    out = {
        r["query_id"]: r
        for r in rag.answer_questions(asked, store.code(), store.mappings(), embed, make_generate, k=5).collect()
    }
    first = out[1]
    assert first["error"] is None and first["answer"].startswith(fixed.SYSTEM_PROMPT[:15])
    assert len(first["retrievals"]) == 5 and len(first["code_retrievals"]) == 3
    assert [h["rank"] for h in first["retrievals"]] == [1, 2, 3, 4, 5]
    text = first["context"]
    assert text.startswith(fixed.CODE_SECTION + "\n\n--- Code File 1 (Similarity: ")
    sections = [text.index(s) for s in (fixed.CODE_SECTION, fixed.EXTRACTED_SECTION, fixed.STORED_SECTION)]
    assert sections == sorted(sections)
    assert "Chunk: 2/2\n\nFull Code:\n" in text
    assert "  home -> depot.name\n" in text and "  city -> place.city\n" in text
    assert (out[2]["error"], out[2]["context"]) == (fixed.NO_EMBEDDING_ERROR, "")
    assert (out[3]["error"], out[3]["answer"]) == (fixed.NO_ANSWER_ERROR, "")


def test_empty_context_and_prompt(spark):
    asked = spark.createDataFrame([(1, "why?")], "query_id int, question string")
    context = rag.build_context(asked, None, None, None, None)
    assert context.first()["context"] == fixed.EMPTY_CONTEXT
    prompt = rag.with_prompt(context).first()["prompt"]
    assert prompt.startswith(f"{fixed.PROMPT_HEAD}why?\n\n{fixed.EMPTY_CONTEXT}\n\nPlease provide:")
    assert prompt.endswith("\n\nAnswer:")


def test_similarity_of_equal_vectors(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.0)], "query_id int, rank int, id string, distance double")
    code = spark.createDataFrame(
        [("a", None, None, None, "x")],
        "id string, file_path string, chunk_index int, total_chunks int, document string",
    )
    text = rag.code_section(hits, code).first()["code_section"]
    assert "Code File 1 (Similarity: 100.00%) ---\nFile: N/A\n\nFull Code:\nx\n" in text
    assert hits.select(knn.similarity()).first()[0] == 1.0


def test_file_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    (inbox / "target").mkdir(parents=True)
    for n in range(5):
        (inbox / f"F{n}.java").write_bytes(f"class F{n} {{}}\r\n".encode())
    (inbox / "target" / "G.java").write_text("class G {}")
    (inbox / "note.txt").write_text("note")
    store = st.Store(spark, str(tmp_path / "store"))

    def run():
        texts = stream.file_stream(spark, str(inbox), exclude=["**/target/**"], files_per_batch=2)
        query = stream.ingest_stream(texts, store, embed, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return rows(stream.stored_progress(store, 5), "processed", "percent")

    seen = run()
    assert len(seen) == 3 and seen[-1] == (5, 100.0)
    got = {r["file_path"].rsplit("/", 1)[1]: r["document"] for r in store.code().collect()}
    assert got == {f"F{n}.java": f"class F{n} {{}}\n" for n in range(5)}
    (inbox / "F9.java").write_text("class F9 {}")
    assert run()[-1][0] == 6 and store.code().count() == 6
    # The same files through a new checkpoint add nothing.
    texts = stream.file_stream(spark, str(inbox))
    stream.ingest_stream(texts, store, embed, str(tmp_path / "other")).awaitTermination()
    assert store.code().count() == 7


LINES = [
    (1, 0, json.dumps({"response": "a"})),
    (1, 1, json.dumps({"message": {"content": "b"}, "done": False})),
    (1, 2, "   "),
    (1, 3, "plain {"),
    (1, 4, json.dumps({"response": "", "done": True})),
    (1, 5, json.dumps({"response": "late"})),
    (2, 0, '{"response": "broken'),
    (2, 1, json.dumps({"other": 1})),
    (3, 0, json.dumps({"response": "x", "done": True})),
]


def test_lines(spark):
    lines = spark.createDataFrame(LINES, "question_id long, seq long, line string")
    chunks = answers.decode_lines(lines)
    assert rows(chunks.where("question_id = 1"), "seq", "chunk", "done") == [
        (0, "a", False), (1, "b", False), (3, "plain {", False), (4, "", True), (5, "late", False),
    ]
    assert rows(chunks.where("question_id = 2"), "chunk") == [('{"response": "broken',)]
    for slice_rows in (1, 2, 4096):
        assert rows(answers.concat_until_done(chunks, slice_rows=slice_rows)) == [
            (1, "abplain {", 4, True), (2, '{"response": "broken', 1, False), (3, "x", 1, True),
        ]


def test_answer_stream_over_batches(spark, tmp_path):
    """State goes on over micro-batches: an answer whose end comes later, and late chunks."""
    schema = "question_id long, seq long, line string"
    inbox = str(tmp_path / "in")
    for part in (LINES[:2], LINES[2:5], LINES[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        chunks = answers.decode_lines(spark.readStream.schema(schema).parquet(inbox))
        query = (
            answers.answers_stream(chunks, timeout_seconds=None)
            .writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1, "abplain {", 4, True), (3, "x", 1, True)]


def test_search(spark):
    texts = [("a", "b.java", "river and mountain"), ("b", "b.java", "paper window"), ("c", "c.java", "river bank")]
    records = embed(spark.createDataFrame(texts, "id string, file_path string, document string"), "document")
    asked = spark.createDataFrame([(1, "river"), (2, " ")], "query_id int, text string")
    found = search.search(records, asked, embed, k=2, preview_chars=5).orderBy("rank").collect()
    assert [(r.query_id, r.file_path, r.preview) for r in found] == [(1, "c.java", "river"), (1, "b.java", "river")]
    only = search.search(records, asked, embed, where={"file_path": "b.java"}).collect()
    assert sorted(r.id for r in only) == ["a", "b"]


def test_extraction_modes(spark):
    source = spark.createDataFrame([("a.java", FLEET), ("b.java", "class B {}")], "file_path string, content string")
    by_rules = {r.file_path: r for r in extraction.extract(source).collect()}
    assert (by_rules["a.java"].total_mappings, by_rules["b.java"].total_mappings) == (5, 0)

    def make():
        return lambda items: ['{"mapping_type": "pojo", "source_type": "X"}' if "class B" in p else "none" for p, _ in items]

    by_model = {r.file_path: r for r in extraction.extract(source, "model", make).collect()}
    assert by_model["a.java"].mappings == by_rules["a.java"].mappings
    assert (by_model["b.java"].pojo_mappings, by_model["b.java"].mappings[0].source_type) == (1, "X")


def test_answers_wait_for_earlier_chunks(spark, tmp_path):
    """Chunks that come after `done`, micro-batches later, take their place in the order."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 2, "c", True), (2, 0, "x", False)], [(1, 0, "a", False)], [(1, 1, "b", False), (2, 1, "y", True)]]
    for batch in batches:
        rows_ = spark.createDataFrame(batch, "question_id long, seq long, chunk string, done boolean")
        rows_.coalesce(1).write.mode("append").parquet(inbox)
    chunks = spark.readStream.schema(rows_.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    (
        answers.answers_stream(chunks, timeout_seconds=None, first_seq=0)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    assert rows(spark.read.parquet(out)) == [(1, "abc", 3, True), (2, "xy", 2, True)]


def test_answer_chunks(spark):
    def make():
        def stream(prompt, system):
            yield from prompt.split()
            if "bad" in prompt:
                raise RuntimeError("broke off")

        return stream

    prompts = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, "")], "query_id int, prompt string")
    got = rows(answers.answer_chunks(prompts, make))
    assert got == [
        (1, 0, "a", False, None), (1, 1, "b", False, None), (1, 2, None, True, None), (2, 0, "bad", False, None),
        (2, 1, None, True, "RuntimeError: broke off"), (3, 0, None, True, None),
    ]


def test_answers_by_number(spark, tmp_path):
    """Descending numbers over micro-batches, a gap, a piece twice, pieces after the end and after the answer."""
    arriving = [
        [(1, 2, "c", True), (2, 1, "y", True), (3, 5, "late", False), (None, 0, "n", True)],
        [(1, 1, None, False), (3, 0, "x", True), (2, 3, "beyond", False)],
        [(1, 0, "a", False), (1, 1, "b", False), (3, 0, "again", True), (2, None, "?", False)],
    ]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in arriving:
        spark.createDataFrame(batch, answers.LINE_COLUMNS).repartition(2).write.mode("append").parquet(inbox)
        chunks = spark.readStream.schema(answers.LINE_COLUMNS).parquet(inbox)
        with gathering.keyed_state(spark):
            query = gathering.answers_by_number(chunks).writeStream.format("parquet").option("path", out)
            query = query.option("checkpointLocation", str(tmp_path / "c")).outputMode("append")
            query.trigger(availableNow=True).start().awaitTermination()
    # Question 2 has no number 0, so it is not complete.
    assert rows(spark.read.parquet(out)) == sorted([(1, "abc", 3, True), (3, "x", 1, True), (None, "n", 1, True)], key=repr)


def test_answers_with_a_gap_go_out_after_the_timeout(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "b", True), (2, 0, "x", True)], answers.LINE_COLUMNS).write.parquet(inbox)
    chunks = spark.readStream.schema(answers.LINE_COLUMNS).parquet(inbox)
    with gathering.keyed_state(spark):
        found = gathering.answers_by_number(chunks, timeout_seconds=1, keep_seconds=60)
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        query = query.outputMode("append").trigger(processingTime="1 second").start()
        try:
            for _ in range(40):
                query.awaitTermination(1)
                if os.path.isdir(out) and spark.read.schema(gathering.ANSWER).parquet(out).count() == 2:
                    break
        finally:
            query.stop()
    assert rows(spark.read.parquet(out)) == [(1, "b", 1, False), (2, "x", 1, True)]


def test_ingest_by_state_reads_no_stored_rows(spark, tmp_path, monkeypatch):
    store = st.Store(spark, str(tmp_path / "store"))
    schema, inbox = "file_path string, content string", str(tmp_path / "in")

    def run(*files):
        spark.createDataFrame(list(files), schema).coalesce(1).write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        query = changes.ingest_changes(arriving, store, embed, str(tmp_path / "c"), with_mappings=True)
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    for n in range(3):
        spark.createDataFrame([(f"n{n}{i}.java", f"file {n} {i}") for i in range(4)], schema).coalesce(1).write.mode("append").parquet(inbox)
    calls, live = [], st.Store.live
    monkeypatch.setattr(st.Store, "live", lambda self, table: calls.append(table) or live(self, table))
    java = "class P { T map(S s) { t.setA(s.getB()); return t; } }"
    # Every micro-batch has its own rows and no more, and none looks into the store.
    assert run(("a.java", java), ("b.java", "one"), ("x.java", None), (None, "y")) == [4, 4, 4, 4] and calls == []
    assert run(("a.java", java), ("b.java", "two"), ("n00.java", None), ("n01.java", "  ")) == [4] and calls == []
    code = {r.file_path: r.document for r in store.code().collect()}
    assert code["a.java"] == java and code["b.java"] == "two" and len(code) == 12
    assert [r.file_path for r in store.mappings().collect()] == ["a.java"]
    assert run(("a.java", "class P {}")) == [1]
    assert store.mappings().count() == 0 and store.code().where("file_path = 'a.java'").count() == 1


def test_a_micro_batch_that_runs_again_adds_nothing(spark, tmp_path):
    store, schema = st.Store(spark, str(tmp_path / "store")), "file_path string, content string"
    spark.createDataFrame([("a.java", "one"), ("b.java", "two")], schema).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    whole = st.Store.delete_files

    def breaks_off(self, *args):
        raise RuntimeError("broke off")

    st.Store.delete_files = breaks_off
    try:
        with pytest.raises(Exception, match="broke off"):
            changes.ingest_changes(arriving, store, embed, str(tmp_path / "c")).awaitTermination()
    finally:
        st.Store.delete_files = whole
    assert store.read(st.CODE).count() == 2
    changes.ingest_changes(arriving, store, embed, str(tmp_path / "c")).awaitTermination()
    assert store.read(st.CODE).count() == 2


def test_log_ranges(tmp_path):
    """Ranges of any size give each line once, with its place."""
    data = "a\n\nlong line é\r\n".encode() + b"\xff\n" + b"x" * 200_000 + b"\nunfinished"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.log").write_bytes(data)
    (tmp_path / "_temporary").write_bytes(b"no\n")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "open").write_bytes(b"y" * 100_000)
    want = [(0, "a"), (2, ""), (3, "long line é"), (17, "\ufffd"), (19, "x" * 200_000)]
    for split in (1, 2, 3, 7, 50_000, 1 << 20):
        logs = answer_log.Logs({"path": str(tmp_path), "splitbytes": str(split)})
        end = logs.ends()
        assert end == {"d/one.log": 200_020}
        parts = logs.ranges({}, end) if split > 1 else logs.ranges({}, end)[:100]
        got = [(r["at"], r["line"]) for p in parts for b in logs.read(p) for r in b.to_pylist()]
        assert got == want
        assert logs.ranges(end, end) == []
        again = [r["at"] for p in logs.ranges({"d/one.log": 3}, end)[:100] for b in logs.read(p) for r in b.to_pylist()]
        assert again == [3, 17, 19]
    with pytest.raises(ValueError, match="shorter"):
        logs.ranges({"d/one.log": 300_000}, end)


def test_log_stream_goes_on_where_it_ended(spark, tmp_path):
    """Logs grow, one in the middle of a line, and a run breaks off: no line is lost or comes twice."""
    logs, out = tmp_path / "logs", str(tmp_path / "out")

    def run(fails=False):
        seen = answer_log.log_lines(spark, str(logs), split_bytes=5)
        if fails:
            seen = seen.withColumn("line", F.when(F.col("line") == "b2", F.raise_error(F.lit("broke off"))).otherwise(F.col("line")))
        query = seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()

    logs.mkdir()
    run()
    (logs / "a.log").write_text("a1\na2\na3 is")
    run()
    assert rows(spark.read.parquet(out), "line") == [("a1",), ("a2",)]
    with open(logs / "a.log", "a") as log:
        log.write(" long\na4\n")
    (logs / "b.log").write_text("b1\nb2\n")
    with pytest.raises(Exception, match="broke off"):
        run(fails=True)
    with open(logs / "b.log", "a") as log:
        log.write("b3\n")
    run()
    run()
    want = [("a.log", 0, "a1"), ("a.log", 3, "a2"), ("a.log", 6, "a3 is long"), ("a.log", 17, "a4"),
            ("b.log", 0, "b1"), ("b.log", 3, "b2"), ("b.log", 6, "b3")]
    want = sorted(want, key=repr)
    assert rows(spark.read.parquet(out), "file", "at", "line") == want
    assert rows(answer_log.log_lines(spark, str(logs), streaming=False), "file", "at", "line") == want


def test_log_pieces(spark):
    lines = ['{"question_id": 1, "seq": 0, "line": "x"}', '{"question_id": 1, "seq": 1}', '{"seq": 2}', "{cut", "", None]
    df = spark.createDataFrame([(t,) for t in lines], "line string")
    assert rows(answer_log.pieces(df)) == [(1, 0, "x"), (1, 1, None)]
