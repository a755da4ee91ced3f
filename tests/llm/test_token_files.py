import os
import zlib

import numpy as np
import pytest
import zstandard

import odd
from fieldtrace.llm import token_files as tf


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tf.tokenizer_path("word_bpe_49k.json"))


def test_round_trip(spark, tokenizer):
    rows = [r for r in odd.texts() if r[0] is not None and r[0] != 26] + [(26, "twice", "s")] * 2
    files = tf.write_tokens(odd.frame(spark, rows), files=3)
    found = sorted((r.start, r.doc_id, bytes(r.tokens)) for r in tf.read_tokens(files).collect())
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((start, doc_id, np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert found == want


def test_null_ids_come_first(spark):
    found = tf.read_tokens(tf.write_tokens(odd.frame(spark), files=2)).orderBy("start").collect()
    assert [r.doc_id for r in found][:2] == [None, None] and len(found) == len(odd.texts())


def test_empty_table(spark):
    assert tf.read_tokens(tf.write_tokens(odd.empty(spark))).count() == 0


ODD = [
    "", "   ", "İ İ K Ǆ ΑΣ ΑΣ.", "it's they'RE 've 'd','s. don't,x 3.14,!? á.́b é!", "\x1c\x85a b c",
    "<|endoftext|> a <|EndOfText|>", "a.,'s b.'s c'.d", "ÉCOLE, été!! École.", "x" * 500, "naïve's ñ's",
    "#tag ##x## &&& $$$a%%% 1234,5678.", "日本語。テスト、abc。",
]


def test_words_are_encoded_as_in_whole_texts(tokenizer):
    got = tf.encoder(tf.tokenizer_path("word_bpe_49k.json"))([t.encode() for t in ODD])
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]


def test_capitals_that_compose_only_when_small(tokenizer):
    texts = ["H\u0331", "T\u0308a, W\u030a. Y\u030a; J\u030c", "xH\u0331 AH\u0331, H\u0331. É, THE Ḫ E\u0301A.", "The THE, ÉA, ÉA"]
    got = tf.encoder(tf.tokenizer_path("word_bpe_49k.json"))([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0].tolist() != tokenizer.encode("h\u0331", add_special_tokens=False).ids


class Counted:
    """A file that tells which bytes are read."""

    def __init__(self, path):
        self.file, self.path, self.got = open(path, "rb"), path, 0

    def size(self):
        return os.path.getsize(self.path)

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        self.got += n
        return self.file.read(n)


def test_one_document_needs_few_frames(tmp_path):
    path, pick = tmp_path / "x", np.random.default_rng(1)
    docs = {i: pick.integers(0, 50_000, 3000 if i != 50 else 40_000).astype(np.uint32) for i in range(100)}
    with open(path, "wb") as out:
        writer = tf.TokenWriter(out, frame_bytes=20_000)
        for doc_id, ids in docs.items():
            writer.add(doc_id, ids)
        writer.close()
    file = Counted(path)
    reader = tf.TokenReader(file)
    assert (reader.document(7) == docs[7]).all()
    assert file.got < file.size() / 10
    assert (reader.document(50) == docs[50]).all() and (reader.document(99) == docs[99]).all()
    # Any Zstandard reader can unpack the frames.
    with open(path, "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert zlib.crc32(whole[: 4 * 3000]) == zlib.crc32(docs[0].tobytes())


def test_damage_is_seen(tmp_path):
    path = tmp_path / "x"
    with open(path, "wb") as out:
        writer = tf.TokenWriter(out)
        writer.add(1, np.arange(1000, dtype=np.uint32))
        writer.close()
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tf.TokenReader(Counted(path)).document(1)
