import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import odd
from fieldtrace.llm import byte_bpe as bb
from fieldtrace.llm.spellings import Spellings

FILE = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(FILE), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strings(seed: int, n: int) -> list[str]:
    """Strings of all kinds of characters, also ones that only newer versions of Unicode know."""
    pick = random.Random(seed)
    kinds = [
        lambda: chr(pick.randrange(32, 127)),
        lambda: pick.choice(" \n\t\r\x0b\x1c\x1f\x85\xa0 　​'"),
        lambda: pick.choice(["'s", "'ll", "'RE", " the", "ing", "12", "…", "é", "é", "ñ"]),
        lambda: chr(pick.choice([pick.randrange(0xA1, 0xD800), pick.randrange(0xE000, 0x110000)])),
        lambda: chr(pick.choice([0x558, 0x88F, 0xA7CB, 0x105C0, 0x1C89, 0x323B0, 0x10D40, 0x16D70])),
    ]
    return ["".join(pick.choice(kinds)() for _ in range(pick.randrange(60))) for _ in range(n)]


def test_ids_of_the_library(library):
    coder = bb._coder(FILE, None)
    texts = [*strings(1, 4000), "", "a" * 3000, "日本語" * 500, " " * 999, "don't" * 50, "<|endoftext|>", "x\x00y"]
    points = bb.np.unique(bb.np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4"))
    bb._learn(points[bb._kinds()[points] == bb.ASK])  # at once, as it takes its time per text
    assert coder.encode([t.encode() for t in texts]).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_patterns_of_kinds():
    assert bb.split(bb.by_kinds(r"\p{L}+|\p{N}"), "ab1²é…x") == ["ab", "1", "²", "é", "x"]
    assert bb.split(bb.by_kinds(r"[\s\[]+|\S"), "a [\x1cé") == ["a", " [", "\x1c", "é"]
    with pytest.raises(ValueError, match="no class"):
        bb.by_kinds(r"\p{Lu}")


def test_every_token_decodes_to_its_bytes(library):
    coder = bb._coder(FILE, None)
    ids = list(range(library.n_vocab))
    found = coder.decode(bb.pa.array([[i] for i in ids], bb.pa.list_(bb.pa.int32()))).to_pylist()
    assert found == [library.decode_single_token_bytes(i) for i in ids]


def test_operator_on_odd_tables(spark, library):
    found = bb.decode(bb.encode(odd.frame(spark)))
    # The odd column `ids` gives way, the others stay.
    assert sorted(found.columns) == sorted({*odd.frame(spark).columns, "ids", "decoded"})
    rows = found.select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == len(odd.texts())
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bb.decode(bb.encode(odd.empty(spark))).count() == 0


def test_null_ids_stay_null_and_unknown_ones_are_an_error(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64])], "k int, ids array<int>")
    assert [r.decoded for r in bb.decode(rows).orderBy("k").collect()][:2] == [None, b""]
    with pytest.raises(Exception, match="an id without a token"):
        bb.decode(rows.select(F.array(F.lit(1 << 30)).alias("ids"))).collect()


def test_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = bb.query(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_spellings_met_again_are_kept():
    asked = []

    def make(spellings):
        asked.extend(spellings)
        return [bb.np.array([len(s)], dtype=bb.np.uint32) for s in spellings]

    known = Spellings(make, limit=3)
    for round_ in range(10):
        ids, sizes = known([b"often", b"x%d" % round_, b"y%d" % round_])
        assert ids.tolist() == [5, 2, 2] and sizes.tolist() == [1, 1, 1]
    assert asked.count(b"often") == 1
