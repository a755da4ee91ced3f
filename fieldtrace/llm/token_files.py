"""Token ids in compressed files that can be read document by document.

A file is a row of independent Zstandard frames in the seekable format: frames of ids (little-endian
unsigned 32-bit, whole documents up to FRAME_BYTES, longer ones cut), a frame that lists the documents,
and a trailing seek table with both sizes and a checksum of each frame. Plain Zstandard tools can
unpack such a file; a reader that wants few documents unpacks only their frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.llm.common import blocks, filesystem, new_folder, ragged, table, written
from fieldtrace.llm.spellings import Spellings

FRAME_BYTES = 1 << 18
BLOCK = 8 << 20
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80


# === files =====================================================================================


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenWriter:
    """Writes documents one after another; `close` adds the list of documents and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.limit = out, frame_bytes
        self.pending: list[np.ndarray] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.add_all([doc_id], np.array([len(ids)]), ids)

    def add_all(self, doc_ids: list[int], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in a row: their ids one after the other, and how many each has."""
        self.ids += doc_ids
        self.counts += counts.tolist()
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        while at < len(doc_ids):
            # As many as the frame has room for; a document that needs more has frames of its own.
            room = (self.limit - self.size) // 4
            upto = int(np.searchsorted(ends, ends[at] + room, "right")) - 1
            if upto == at and not self.size:
                upto = at + 1
            self.pending.append(ids[ends[at] : ends[upto]])
            self.size += 4 * int(ends[upto] - ends[at])
            at = upto
            if at < len(doc_ids) or self.size >= self.limit:
                self._flush()

    def _flush(self) -> None:
        data = b"".join(part.astype("<u4", copy=False).tobytes() for part in self.pending)
        for at in range(0, len(data), self.limit):
            self._frame(data[at : at + self.limit])
        self.pending, self.size = [], 0

    def _frame(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), _checksum(data)))

    def close(self) -> None:
        self._flush()
        lists = [np.array(x, dtype="<i8").tobytes() for x in (self.ids, self.counts)]
        self._frame(b"".join(lists))
        entries = b"".join(struct.pack("<III", *frame) for frame in self.frames)
        foot = struct.pack("<IBI", len(self.frames), WITH_CHECKSUM, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot)


class TokenReader:
    """Reads documents of a file, unpacking only the frames they lie in."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUM:
            raise ValueError("no seek table")
        entries = np.frombuffer(self._read(end - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.frames = entries.astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.begins = np.concatenate([[0], np.cumsum(self.frames[:, 1])])[:-1]
        self.kept: tuple[int, bytes] = (-1, b"")
        listed = np.frombuffer(self.frame(n - 1), dtype="<i8").reshape(2, -1)
        self.ids, self.counts = listed
        self.starts = np.cumsum(self.counts) - self.counts

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, number: int) -> bytes:
        if self.kept[0] != number:
            size, full, checksum = self.frames[number]
            packed = self._read(int(self.places[number]), int(size))
            data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(full))
            if len(data) != full or _checksum(data) != checksum:
                raise ValueError(f"frame {number} is damaged")
            self.kept = (number, data)
        return self.kept[1]

    def tokens(self, first: int, last: int | None = None) -> bytes:
        """The ids of the document at a place of the list, or of those up to another place, as bytes."""
        last = first if last is None else last
        start, end = 4 * int(self.starts[first]), 4 * int(self.starts[last] + self.counts[last])
        number = int(np.searchsorted(self.begins[:-1], start, "right")) - 1
        parts = []
        while start < end:
            begin = int(self.begins[number])
            part = self.frame(number)[start - begin : end - begin]
            parts.append(part)
            start, number = start + len(part), number + 1
        return b"".join(parts)

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of a document, found by its id."""
        return np.frombuffer(self.tokens(int(np.flatnonzero(self.ids == doc_id)[0])), dtype="<u4")


# === encoding ==================================================================================


class WordEncoder:
    """Encodes texts with a tokenizer that never joins what white space parts.

    Equal spellings are encoded once: a text's ids are those of its spellings in a row. In plain ASCII words
    A-Z become a-z before, as the tokenizer does itself; others keep their case, as it composes letters
    with marks first. Marks like full stops after a small Latin letter or a digit, a piece of their own
    for it, are spelt apart. Texts that may hold the tokenizer's special tokens go to it whole.
    """

    MARKS = np.isin(np.arange(256), list(b".,!?;:*$%&#|"))
    PLAIN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Spellings(lambda words: self.whole([w.decode() for w in words]))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of every text."""
        ids, counts = self.rows(texts)
        return np.split(ids, np.cumsum(counts)[:-1])

    def rows(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's with `end_id` behind, and how many each has."""
        special = [at for at, text in enumerate(texts) if b"<|" in text]
        plain = list(texts)
        for at in special:
            plain[at] = b""
        words = pc.ascii_split_whitespace(pa.array(plain, pa.binary()).cast(pa.string()))
        flat = words.flatten()
        flat = pc.if_else(pc.string_is_ascii(flat), pc.ascii_lower(flat), flat)
        flat, n_spelt = self._spelt(flat)
        codes = flat.dictionary_encode()
        ids, sizes = self.known(codes.dictionary.cast(pa.binary()).to_pylist())
        code = codes.indices.to_numpy()
        found, ends = ragged(ids, (np.cumsum(sizes) - sizes)[code], sizes[code])
        # Ids before each word, then before each text.
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_spelt)])]
        cuts = before[words.offsets.to_numpy() - words.offsets[0].as_py()]
        if special:
            parts = np.split(found, cuts[1:-1])
            for at, whole in zip(special, self.whole([texts[at].decode() for at in special]), strict=True):
                parts[at] = whole
            found, cuts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        if end_id is not None:
            found = np.insert(found, cuts[1:], np.uint32(end_id))
        return found, np.diff(cuts) + (end_id is not None)

    def _spelt(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The spellings of all words, and how many each word has: 0 (empty), 1, or 2 with marks."""
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset :][: len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[: offsets[-1]]
        starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        firm = np.concatenate([[-1], np.where(self.MARKS[data], -1, np.arange(len(data)))])
        last = np.maximum.accumulate(firm)[ends]  # the last byte of the word that is no mark
        split = (last >= starts) & (last + 1 < ends)
        split[split] = self.PLAIN[data[last[split]]]
        counts = np.where(split, 2, (ends > starts).astype(np.int64))
        at = np.cumsum(counts) - counts
        cuts = np.zeros(int(counts.sum()) + 1, dtype=np.int32)
        cuts[0] = offsets[0]
        cuts[at[counts > 0] + 1] = np.where(split, last + 1, ends)[counts > 0]
        cuts[at[split] + 2] = ends[split]
        buffers = [None, pa.py_buffer(cuts), pa.py_buffer(data)]
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, buffers), counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# === the operator ==============================================================================


def write_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    end_id: int | None = 1,
    folder: str | None = None,
    files: int | None = None,
) -> DataFrame:
    """Encodes all texts and writes them by ascending id; returns the files in order.

    One row per file: file, n_docs, n_tokens, start (tokens in all files before). Each task writes one
    range of ids. Its file appears whole under a name of its own by a rename; a lost or repeated
    task leaves at most a file that no row names. A null text is empty and gets its end id; rows with
    a null id come first, with the least 64-bit number as id; rows that share an id go by their text.
    `tokenizer` is a file name in the public vocabulary package, or a path all executors can read.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = filesystem(folder)
        context = TaskContext.get()
        name = f"{context.partitionId():05d}-{context.taskAttemptId()}.tokens"
        encode = encoder(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        with system.open_output_stream(f"{inner}/.{name}", compression=None) as out:
            writer = TokenWriter(out)
            for rows, texts in blocks(batches, "text", BLOCK):
                ids = rows["id"].fill_null(np.iinfo(np.int64).min).to_pylist()
                found, counts = encode.rows(texts, end_id)
                writer.add_all(ids, counts, found)
            writer.close()
        system.move(f"{inner}/.{name}", f"{inner}/{name}")
        if writer.ids:
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([context.partitionId()], pa.int32()),
                    "file": [f"{folder}/{name}"],
                    "n_docs": pa.array([len(writer.ids)], pa.int64()),
                    "n_tokens": pa.array([int(sum(writer.counts))], pa.int64()),
                }
            )

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    dealt = narrow.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    found = written(dealt.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "token-files")
    # One row per file: a few for each task of the cluster.
    rows, start, result = sorted(found.collect()), 0, []
    for row in rows:
        result.append((row.part, row.file, row.n_docs, row.n_tokens, start))
        start += row.n_tokens
    return spark.createDataFrame(
        result, "part int, file string, n_docs long, n_tokens long, start long"
    )


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), tokens (its ids as bytes) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                system, inner = filesystem(path)
                with system.open_input_file(inner) as file:
                    reader = TokenReader(file)
                    first = 0
                    while first < len(reader.ids):
                        # Documents of about a megabyte together.
                        upto = np.searchsorted(reader.starts, reader.starts[first] + (1 << 18), "right")
                        last = max(first, int(upto) - 2)
                        at = slice(first, last + 1)
                        cuts = 4 * np.concatenate([[0], np.cumsum(reader.counts[at])])
                        sizes, data = pa.py_buffer(cuts), pa.py_buffer(reader.tokens(first, last))
                        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, sizes, data])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(reader.ids[at]),
                                "start": pa.array(start + reader.starts[at]),
                                "tokens": ids.cast(pa.binary()),
                            }
                        )
                        first = last + 1

    dealt = files.repartition(max(1, files.count())).select("file", "start")
    found = dealt.mapInArrow(run, "doc_id long, start long, tokens binary")
    null = F.col("doc_id") == np.iinfo(np.int64).min
    return found.withColumn("doc_id", F.when(~null, F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = read_tokens(write_tokens(docs))
    return found.select(
        "doc_id",
        "start",
        F.expr("cast(octet_length(tokens) div 4 as bigint)").alias("n_tokens"),
        F.crc32("tokens").alias("ids_crc32"),
    )
