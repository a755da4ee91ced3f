"""File trees, the store, and result sinks."""

import pytest
from conftest import rows
from java import FLEET
from pyspark.sql import functions as F

from fieldtrace import fixed
from fieldtrace.operators import embedding, progress
from fieldtrace.plans import entries as en, ingest, lineage
from fieldtrace.sources import files, reports, store as st


def embed(df, text_col):
    return embedding.hash_embed(df, text_col)


@pytest.fixture()
def tree(tmp_path):
    contents = {
        "a/X.java": b"class X {}\r\n",
        "a/target/G.java": b"class G {}",
        "target/H.java": b"class H {}",
        "a/src/test/Y.java": b"class Y {}",
        "a/FooTest.java": b"class FooTest {}",
        "a/note.txt": b"note",
        "a/Latin.java": "class L { // größe\n}".encode("latin-1"),
        "b c+d/Space%20.java": "class S { // größe � \n}".encode(),
    }
    for name, data in contents.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "tree")


def names(df, root):
    return sorted(r["file_path"][len(root) + 1 :] for r in df.select("file_path").collect())


def test_scan(spark, tree):
    every = files.scan_files(spark, tree)
    assert len(names(every, tree)) == 7
    kept = files.scan_files(spark, tree, exclude=fixed.EXCLUDE_PATTERNS)
    assert names(kept, tree) == ["a/Latin.java", "a/X.java", "b c+d/Space%20.java"]
    flat = files.scan_files(spark, tree + "/a", recursive=False)
    assert names(flat, tree) == ["a/FooTest.java", "a/Latin.java", "a/X.java"]
    assert names(files.scan_files(spark, tree + "/a/X.java"), tree) == ["a/X.java"]
    both = files.scan_files(spark, tree, extensions=[".java", ".txt"])
    assert len(names(both, tree)) == 8


def test_read(spark, tree):
    texts = {r[0][len(tree) + 1 :]: r[1] for r in files.read_text(files.scan_files(spark, tree)).select("file_path", "content").collect()}
    assert texts["a/X.java"] == "class X {}\n"
    assert texts["a/Latin.java"] == "class L { // gre\n}"
    assert texts["b c+d/Space%20.java"] == "class S { // größe � \n}"
    strict = files.read_text(files.scan_files(spark, tree), strict=True)
    assert names(strict.where("error is not null"), tree) == ["a/Latin.java"]
    assert strict.where("error is not null and content is null").count() == 1


def test_roots(spark, tree):
    roots = [f" {tree}/a ", "", "/nowhere/at/all", f"{tree}/target"] + [tree] * 9
    used = files.usable_roots(spark, roots)
    assert [u[0] for u in used] == [1, *range(3, 14)]
    # Roots inside others, or given again, add nothing.
    once = rows(files.scan_roots(spark, [tree]), "file_path")
    assert rows(files.scan_roots(spark, roots), "file_path") == once and len(set(once)) == len(once)
    texts = files.scan_roots(spark, roots[:4])
    assert rows(files.root_report(spark, roots[:4], texts), "project_index", "found", "n_files") == [
        (1, True, 5), (3, False, 0), (4, True, 1),
    ]
    assert files.scan_roots(spark, ["/nowhere/at/all"]).count() == 0


def test_inline(spark):
    assert files.inline_source(spark, "class A {}").first()["file_path"] == "inline"


@pytest.fixture()
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path / "store"))


def sources(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file_path string, content string")


def test_store_life(spark, store):
    texts = sources(spark, {"a.java": FLEET, "b.java": "class B {}", "c.java": "  \n", "d.java": "x " * 2500})
    assert ingest.ingest(store, texts, embed, with_mappings=True) == 1
    assert rows(progress.store_stats(store.code(), store.mappings())) == [(3, 5, 5)]
    ingest.ingest(store, texts, embed, with_mappings=True)
    assert rows(progress.store_stats(store.code(), store.mappings())) == [(3, 5, 5)]
    log = ingest.ingest_log(texts, store.code())
    assert rows(log, "file", "status") == [
        ("a.java", "stored"), ("b.java", "stored"), ("c.java", "skipped"), ("d.java", "stored"),
    ]
    # Deleted rows are gone and can come again.
    store.delete_files(st.CODE, texts.where("file_path = 'd.java'"))
    assert sorted({r[0] for r in rows(store.code(), "file_path")}) == ["a.java", "b.java"]
    ingest.ingest(store, texts, embed)
    assert store.code().count() == 5
    store.delete_ids(st.CODE, store.code().where("file_path = 'b.java'"))
    assert store.code().where("file_path = 'b.java'").count() == 0
    assert store.mappings().count() == 5
    # A changed file is left alone, or replaced.
    changed = sources(spark, {"d.java": "y"})
    ingest.ingest(store, changed, embed)
    assert store.code().where("file_path = 'd.java'").count() == 4
    ingest.ingest(store, changed, embed, mode="replace")
    assert rows(store.code().where("file_path = 'd.java'"), "document", "chunk_index") == [("y", None)]
    store.reset(code=False)
    assert (store.mappings().count(), store.code().where("file_path = 'd.java'").count()) == (0, 1)
    store.reset()
    assert (store.mappings().count(), store.code().count()) == (0, 0)
    ingest.ingest(store, texts, embed)
    assert store.code().count() == 5


def test_mapping_records(spark, store):
    source = files.inline_source(spark, FLEET, "a.java")
    entries = en.entries(lineage.field_mappings(source))
    extra = F.create_map(F.lit("team"), F.lit("t1"), F.lit("method"), F.lit("other"))
    records = st.mapping_records(entries, source, extra)
    first = records.orderBy("pos").first()
    assert (first["method"], first["extra"]) == ("other", {"team": "t1"})
    assert first["document"].startswith(
        "Mapping Type: mapstruct\nSource Type: Truck\nTarget Type: Plate\n"
        "Interface: TruckMapping\nMethod: plate\n\nCode:\n"
    )
    assert first["document"].endswith(FLEET)
    again = st.batch_records(entries.unionByName(entries.withColumn("pos", F.col("pos") + 1000)))
    ids = [r["id"] for r in again.collect()]
    assert len(set(ids)) == len(ids) == 10 and sum(i.endswith("_1") for i in ids) == 5
    assert st.listing(records, 3).count() == 3 and st.listing(records).count() == 5


def test_reports(spark, tmp_path):
    log = spark.createDataFrame(
        [("a", "stored", True, None), ("b", "failed", False, "invalid UTF-8")],
        "file string, status string, code_stored boolean, error string",
    )
    reports.write_json(log, str(tmp_path / "json"))
    assert rows(spark.read.text(str(tmp_path / "json/results"))) == [
        ('{"error":"invalid UTF-8","file":"b"}',),
        ('{"file":"a","status":"stored","summary":{"code_stored":true}}',),
    ]
    assert rows(spark.read.text(str(tmp_path / "json/totals"))) == [
        ('{"files_processed":2,"files_stored":1,"summary":{"code_files_stored":1}}',)
    ]
    assert rows(reports.result_line(log), "line")[0] == ("File: a, Status: stored",)
    source = files.inline_source(spark, FLEET, "a.java")
    text = en.text_report(source, en.entries(lineage.field_mappings(source)))
    reports.write_text(text, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).first()[0] == "File: a.java"


def test_code_of_mappings_is_not_held(spark, tmp_path, monkeypatch):
    """Each mapping's text has its file's whole code, but only in the table."""
    maps = " ".join(f'@Mapping(source = "a", target = "b{i}") T{i} m{i}(S s);' for i in range(20))
    code = f"@Mapper interface M {{ {maps} }} /* {'x' * 50_000} */"
    real, held = st.hold, []
    monkeypatch.setattr(st, "hold", lambda df: held.append(real(df)) or held[-1])
    store = st.Store(spark, str(tmp_path / "s"))
    ingest.ingest(store, files.inline_source(spark, code, "a.java"), embedding.hash_embed, with_mappings=True)
    longest = [df.selectExpr("max(length(document))").first()[0] for df in held if "document" in df.columns]
    assert longest and max(longest) < 1000
    stored = [r.document for r in store.mappings().select("document").collect()]
    assert len(stored) == 20 and all(d.endswith("\nCode:\n" + code) for d in stored)
