import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import odd
from fieldtrace.llm import stream_dedup as sd


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[plain(text)].append((doc_id, len(text or "")))
    found = []
    for text, members in groups.items():
        best = sorted(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0][0]
        digest = hashlib.sha256(text.encode()).hexdigest()
        found += [(m[0], best, len(members), digest) for m in members]
    return sorted(found, key=repr)


def got(found):
    columns = "doc_id", "keep_id", "group_size", "text_sha256"
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)


def rows_():
    more = [(100, "same text", "s"), (101, "same  text ", "s"), (99, "same  text ", "s"), (102, "sametext", "s")]
    return odd.texts() + more


@pytest.mark.parametrize("bits", [256, 8])
def test_against_brute_force(spark, tmp_path, bits):
    """With eight bits many texts share a digest, and the comparison of full texts parts them."""
    odd.frame(spark, rows_()).repartition(3).write.parquet(str(tmp_path / "t"))
    found = sd.deduplicate(spark, str(tmp_path / "t"), bits=bits)
    assert got(found) == brute(rows_())
    assert found.where("kept").count() == len({plain(r[1]) for r in rows_()})


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    rows = rows_()
    odd.frame(spark, rows[:10]).write.parquet(path)
    first = sd.fold_stream(spark, path, checkpoint, batch_bytes=1)
    assert first.agg(F.sum("n")).first()[0] == 10
    odd.frame(spark, rows[10:]).coalesce(2).write.mode("append").parquet(path)
    assert sd.fold_stream(spark, path, checkpoint, batch_bytes=1).agg(F.sum("n")).first()[0] == len(rows)
    assert got(sd.deduplicate(spark, path, checkpoint=checkpoint)) == brute(rows)


def test_single_file_and_empty_table(spark, tmp_path):
    odd.frame(spark, rows_()).coalesce(1).write.parquet(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*.parquet")
    assert got(sd.deduplicate(spark, str(file))) == brute(rows_())
    odd.empty(spark).write.parquet(str(tmp_path / "e"))
    assert sd.deduplicate(spark, str(tmp_path / "e")).count() == 0
