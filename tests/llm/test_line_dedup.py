import hashlib
from collections import defaultdict

import numpy as np
import pytest

import odd
from fieldtrace.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(SPACE).translate(low)
    holders = defaultdict(list)
    for i, (doc, text, _) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append((i, ld.NO_ID if doc is None else doc))
    keeper = {k: max(d for _, d in v) for k, v in holders.items() if len(v) >= min_docs}
    found = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        own = ld.NO_ID if doc is None else doc
        kept = [x for x in lines if keeper.get(key(x), own) == own]
        found.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(found, key=repr)


def test_against_brute_force(spark):
    found = ld.drop_lines(odd.frame(spark))
    assert "Score" in found.columns and "a.b" in found.columns
    got = sorted((tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert got == brute(odd.texts())
    assert sum(r[3] for r in got) > 0


def test_empty_table(spark):
    assert ld.drop_lines(odd.empty(spark)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    shard = ld.Shard(ld.shard_bytes(keys, keys + np.uint64(7), np.arange(len(keys)), np.arange(len(keys))))
    known, keeper = shard.keeper(keys, keys + np.uint64(7))
    assert known.all() and (keeper == np.arange(len(keys))).all()
    assert sorted(keeper) == list(range(len(keys)))
    known, _ = shard.keeper(keys + np.uint64(1), keys)
    assert not known.any()


@pytest.mark.parametrize("shard_lines", [1, 1000])
def test_equal_first_hashes_and_many_shards(spark, shard_lines):
    rows = [(5, 1, 9, 3), (5, 2, 9, 4), (5, 3, 9, 5), (-8, 1, 9, 6), (1 << 40, 9, 9, 7)]
    files = ld.build_index(spark.createDataFrame(rows, "h1 long, h2 long, n_docs long, keeper long"), shard_lines)
    h1, h2 = (np.array(x, dtype=np.int64).view(np.uint64) for x in ([r[0] for r in rows], [r[1] for r in rows]))
    known, keeper = ld.Index(files).keepers(h1, h2)
    assert known.all() and keeper.tolist() == [3, 4, 5, 6, 7]
    assert not ld.Index(files).keepers(h1, h2 + np.uint64(100))[0].any()


def test_digest_of_rest(spark):
    rows = [(i, "A shared line that is long enough to be counted.\nown", "s") for i in range(6)]
    got = {r.doc_id: r.text for r in ld.drop_lines(odd.frame(spark, rows)).collect()}
    assert hashlib.sha256(got[0].encode()).hexdigest() == hashlib.sha256(b"own").hexdigest()
    assert got[5] == rows[5][1]
