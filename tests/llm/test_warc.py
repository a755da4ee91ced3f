import gzip
import io
import random
from hashlib import sha1

import pytest

from fieldtrace.llm import warc

BIG = "<p>" + "x" * 1200 + "é</p>"
ROWS = [
    (1, "http://a/1", BIG), (9, "http://a/9", BIG), (4, None, BIG), (2, "http://b\r\nX: y", "<p>small</p>"),
    (3, "http://b", "<p>small</p>"), (5, "u", None), (6, "u", ""), (None, "u", BIG), (7, "u", "\x1f\x8b\x08" * 900),
    (8, "u", "a\r\n\r\nb" * 300), (9, "http://a/9", BIG), (-3, "u", "y" * 1000), (-4, "u", "y" * 1000),
    (11, "long", "z" * 3_000_000),
]


def frame(spark, rows=ROWS):
    full = [(*r, "clash") for r in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, digest string")


def want(rows):
    found = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        equal = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        last = max(equal) if equal and len(body) >= 1000 else page_id
        kind = "response" if last == page_id else "revisit"
        found.append((page_id, len(body), sha1(body).hexdigest(), kind, None if kind == "response" else last))
    return sorted(found, key=repr)


@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_round_trip(spark, split):
    files = warc.write_warc(frame(spark).repartition(2))
    found = warc.read_warc(files, split_bytes=split)
    columns = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=repr) == want(ROWS)
    whole = {r.page_id: bytes(r.payload) for r in found.collect() if r.record_type == "response"}
    assert whole[8] == ROWS[9][2].encode() and whole[11] == ROWS[13][2].encode()


def test_empty_table_and_only_null_ids(spark):
    assert warc.read_warc(warc.write_warc(frame(spark, []))).count() == 0
    found = warc.read_warc(warc.write_warc(frame(spark, [(None, "u", BIG)] * 2)))
    assert [r.record_type for r in found.collect()] == ["response"] * 2


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_every_record_has_one_owner():
    pick = random.Random(2)
    bodies = [bytes(pick.choices(b"abc \x1f\x8b\x08", k=pick.randrange(4000))) for _ in range(60)]
    data = [warc.record_bytes(i, "u", b, sha1(b).hexdigest(), None, warc.DATE) for i, b in enumerate(bodies)]
    whole = b"".join(data)
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == 60
    for step in (37, 1000, len(whole)):
        found = [
            warc.parse_record(r)["page_id"]
            for at in range(0, len(whole), step)
            for r in warc.records(File(whole), len(whole), at, at + step)
        ]
        assert found == list(range(60))


def test_damage_is_an_error():
    record = warc.record_bytes(1, "u", b"payload", "0" * 40, None, warc.DATE)
    with pytest.raises(ValueError):
        warc.parse_record(gzip.decompress(record))
    with pytest.raises(ValueError):
        list(warc.records(File(record[:-20]), len(record) - 20, 0, 10))
