"""WARC archives: written by tasks, read back in byte ranges.

Every record is a gzip member of its own. A reading task owns the records that start in its range: it
looks for the gzip magic, takes a place for a member only if its first bytes unpack to a WARC header,
and from there goes from member to member, past the end of its range if the last record does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.llm.common import filesystem, new_folder, table, written
from fieldtrace.session import small

REVISIT_BYTES = 1000  # payloads below are stored whole each time
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 18
PROBE_BYTES = 1 << 12
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# === one record ================================================================================


def _line(name: str, value: object) -> bytes:
    return f"{name}: {value}\r\n".encode()


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """A response, or a revisit of record `refers_to`, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += _line("Content-Length", len(payload)) + b"\r\n"
    block = http if refers_to is not None else http + payload
    head = b"WARC/1.1\r\n" + _line("WARC-Type", "response" if refers_to is None else "revisit")
    head += _line("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")
    head += _line("WARC-Date", date)
    if url is not None:
        # Line breaks cannot stand in a header.
        head += _line("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))
    head += _line("WARC-Payload-Digest", f"sha1:{digest}")
    if refers_to is not None:
        head += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", f"<urn:page:{refers_to}>")
    head += _line("Content-Type", "application/http; msgtype=response")
    head += _line("Content-Length", len(block)) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode(errors="replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def parse_record(data: bytes) -> dict:
    """The columns of an unpacked record. Of a revisit, size and digest are those of the payload it
    stands for."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    revisit = fields.get("warc-type") == "revisit"
    if revisit:
        size, digest, payload = int(_headers(http).get("content-length", 0)), stated, None
    else:
        size, digest = len(payload), sha1(payload).hexdigest()
        if stated not in (None, digest):
            raise ValueError(f"payload of {fields.get('warc-record-id')} is damaged")
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "refers_to": _page(fields.get("warc-refers-to")) if revisit else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


# === ranges of a file ==========================================================================


class _Window:
    """Bytes of a file around a moving place."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, least: int = 1) -> memoryview:
        """What is at hand from a place on: `least` bytes or more, fewer only at the end."""
        least = min(least, self.size - at)
        if not (self.at <= at and at + least <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(least, READ_BYTES))
        return memoryview(self.data)[at - self.at :]

    def find(self, at: int) -> int | None:
        """The next place of the magic."""
        while at < self.size:
            self.get(at, len(MAGIC))
            hit = self.data.find(MAGIC, at - self.at)
            if hit >= 0:
                return self.at + hit
            at = self.at + len(self.data) - len(MAGIC) + 1
            if self.at + len(self.data) >= self.size:
                return None
        return None


def _is_record(window: _Window, at: int) -> bool:
    """Whether a gzip member that unpacks to a WARC header starts here."""
    try:
        start = zlib.decompressobj(31).decompress(window.get(at, PROBE_BYTES)[:PROBE_BYTES], 16)
    except zlib.error:
        return False
    return start.startswith(b"WARC/")


def _find(window: _Window, at: int, end: int) -> int | None:
    """The first record that starts in [at, end)."""
    while at < end:
        hit = window.find(at)
        if hit is None or hit >= end:
            return None
        if _is_record(window, hit):
            return hit
        at = hit + 1
    return None


def records(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The unpacked records that start in [start, end)."""
    window = _Window(file, size)
    at = _find(window, start, min(end, size))
    while at is not None:
        unpacker, parts, place = zlib.decompressobj(31), [], at
        while not unpacker.eof and place < size:
            data = window.get(place)
            parts.append(unpacker.decompress(data))
            place += len(data) - len(unpacker.unused_data)
        if not unpacker.eof:
            raise ValueError(f"record at {at} is cut off")
        yield b"".join(parts)
        at = _find(window, place, min(end, size))


# === the operator ==============================================================================


def write_warc(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str | None = "url",
    payload_col: str = "html",
    folder: str | None = None,
    revisit_bytes: int = REVISIT_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Writes one record per row; returns the files: file, bytes, n_records.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least
    `revisit_bytes`, those with the largest id are responses and the others revisit it; null ids are
    below all others, and if all are null, all are responses. Equal means equal by SHA-256 and size.
    A task's file gets its name by a rename when it is whole, and only files of tasks that ended well
    are returned.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.col(f"`{url_col}`") if url_col else F.lit(None)).cast("string").alias("url"),
        payload.alias("payload"),
        F.when(F.octet_length(payload) >= revisit_bytes, F.unhex(F.sha2(payload, 256))).alias("key"),
    )
    shared = rows.where(F.col("key").isNotNull()).groupBy("key")
    shared = shared.agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared.select("key", "last"), "warc-shared")
    rows = rows.join(small(shared), "key", "left").select(
        "id",
        "url",
        "payload",
        F.sha1("payload").alias("digest"),
        F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = filesystem(folder)
        context = TaskContext.get()
        name = f"{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        size = n = 0
        with system.open_output_stream(f"{inner}/.{name}", compression=None) as out:
            for batch in batches:
                for row in zip(*[batch.column(i) for i in range(batch.num_columns)], strict=True):
                    page_id, url, body, digest, refers_to = (value.as_py() for value in row)
                    size += out.write(record_bytes(page_id, url, body, digest, refers_to, date))
                    n += 1
        system.move(f"{inner}/.{name}", f"{inner}/{name}")
        if n:
            yield pa.RecordBatch.from_pydict(
                {"file": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64()),
                 "n_records": pa.array([n], pa.int64())}
            )

    return written(rows.mapInArrow(run, "file string, bytes long, n_records long"), "warc-files")


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of archives (file, bytes), read in ranges of `split_bytes`.

    page_id, url, record_type, refers_to, payload_bytes, payload_digest, and the payload (null for
    revisits). A response whose payload does not have its stated digest is an error. An archive that
    holds other archives uncompressed within a member needs `split_bytes` as large as its files.
    """
    ranges = files.select(
        "file", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start")
    )
    n = ranges.count()
    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
        "payload_digest string" + (", payload binary" if with_payload else "")
    )
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    shape = pa.schema(list(zip(names, kinds, strict=True))[: 7 if with_payload else 6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system, inner = filesystem(path)
                with system.open_input_file(inner) as file:
                    for data in records(file, file.size(), start, start + split_bytes):
                        held.append(parse_record(data))
                        size += len(data)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, shape)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, shape)

    # Ranges take like time, so they are dealt round robin.
    return ranges.repartition(max(1, n)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"))
    found = read_warc(files, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with payloads as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, coalesce(html, '') as html from pages),
last as (
  select *, max(page_id) over (partition by html) as last from payloads)
select page_id, cast(n as bigint) as payload_bytes, sha1(html) as payload_digest,
       case when n < 1000 or page_id = last then 'response' else 'revisit' end as record_type,
       case when n < 1000 or page_id = last then null else last end as refers_to
from last"""
