"""Byte-level BPE by a sentencepiece model that is made from a list of ranks.

Every byte becomes one character, every token a piece of those characters, and its score is the negative
rank: joining the neighbours with the best score is then joining those with the least rank. The model
normalises nothing and adds nothing. Texts are split by the pattern first, each part is encoded by itself,
and ids are decoded by going from pieces back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fieldtrace.llm.common import add_columns, packed_columns, ragged, table, unpacked, without
from fieldtrace.llm.spellings import Spellings

FIRST = 0x100  # byte b is the character FIRST + b
UNKNOWN = "unknown"  # a piece that has to be there; no spelling holds its characters
DECODED_IDS = 1 << 20  # decoded at once
TEXT_BYTES = 1 << 20  # of texts encoded together


# === the model =================================================================================


def _varint(number: int) -> bytes:
    found = bytearray()
    while number > 127:
        found.append(number & 127 | 128)
        number >>= 7
    return bytes([*found, number])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One field of a protocol buffer: integers as varints, floats as 32 bits, the rest by length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def characters(spelling: bytes) -> str:
    return spelling.decode("latin-1").translate(_SHIFTED)


_SHIFTED = {b: FIRST + b for b in range(256)}


def serialised(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of merges; `tokens` stand by rank, and a piece's number is its place."""
    # Fixed values of the format: field numbers, kinds of pieces and of models.
    piece, trainer, normaliser = 1, 2, 3
    text, score, kind, normal, unknown = 1, 2, 3, 1, 2
    model_type, merges, vocab_size, unk_id, bos_id, eos_id, pad_id, unk_piece = 3, 2, 4, 40, 41, 42, 43, 45
    name, dummy_prefix, remove_spaces, escape_spaces = 1, 3, 4, 5
    absent = (1 << 64) - 1  # -1
    parts = [
        _field(piece, _field(text, characters(t)) + _field(score, float(-i)) + _field(kind, normal))
        for i, t in enumerate(tokens)
    ]
    last = float(-len(tokens))
    parts.append(_field(piece, _field(text, UNKNOWN) + _field(score, last) + _field(kind, unknown)))
    spec = _field(model_type, merges) + _field(vocab_size, len(tokens) + 1) + _field(unk_id, len(tokens))
    spec += b"".join(_field(i, absent) for i in (bos_id, eos_id, pad_id)) + _field(unk_piece, UNKNOWN)
    plain = _field(name, "identity") + b"".join(_field(i, 0) for i in (dummy_prefix, remove_spaces, escape_spaces))
    return b"".join(parts) + _field(trainer, spec) + _field(normaliser, plain)


# === parts of texts ============================================================================


# Texts are matched by kinds of characters: ASCII stands for itself, others for their kind.
LETTER, NUMBER, SPACE, OTHER, ASK = 0x80, 0x81, 0x82, 0x83, 0xFF
KINDS = {r"\p{L}": "A-Za-z\x80", r"\p{N}": "0-9\x81", r"\s": "\t-\r \x82"}


def by_kinds(pattern: str) -> re.Pattern:
    """A pattern of the classes `\\p{L}`, `\\p{N}`, `\\s` and `\\S` and of ASCII characters, for texts of kinds."""
    found, at, inside = "", 0, False
    while at < len(pattern):
        part = next((k for k in [*KINDS, r"\S"] if pattern.startswith(k, at)), pattern[at : at + 1])
        if part == "\\":
            part = pattern[at : at + 2]
            if part[1:].isalnum() and part[1:] not in "nrt":
                raise ValueError(f"no class {part} in patterns")
        at += len(part)
        if part in KINDS:
            found += KINDS[part] if inside else f"[{KINDS[part]}]"
        elif part == r"\S":
            if inside:
                raise ValueError("no class \\S in brackets")
            found += "[^" + KINDS[r"\s"] + "]"
        else:
            inside = (inside or part == "[") and part != "]"
            found += part
    return re.compile(found, re.ASCII)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every character. Those Python's Unicode does not know are asked for when met, as the
    rank library may have another version."""

    def kind(char: str) -> int:
        category = unicodedata.category(char)
        if char.isspace() and (category != "Cc" or char == "\x85"):
            return SPACE
        return {"L": LETTER, "N": NUMBER}.get(category[0], ASK if category == "Cn" else OTHER)

    return np.array([*range(128), *[kind(chr(c)) for c in range(128, 0x110000)]], dtype=np.uint8)


def _learn(points: np.ndarray) -> None:
    """Notes the kinds that the rank library sees in characters."""
    import tiktoken

    chars = [chr(c) for c in points]
    ranks = {bytes([b]): b for b in range(256)}
    for before in (b"a", b"1"):
        first = len(ranks)
        ranks |= {before + c.encode(): first + i for i, c in enumerate(chars)}
    pattern = r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+"
    asked = tiktoken.Encoding("kinds", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for point, char in zip(points, chars, strict=True):
        alike = (k for k, before in ((LETTER, "a"), (NUMBER, "1")) if len(asked.encode_ordinary(before + char)) == 1)
        _kinds()[point] = next(alike, OTHER)


def split(pattern: re.Pattern, text: str) -> list[str]:
    """The matches of a pattern of kinds in a row."""
    if text.isascii():
        return pattern.findall(text)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    kinds = _kinds()[points]
    if (kinds == ASK).any():
        _learn(np.unique(points[kinds == ASK]))
        kinds = _kinds()[points]
    usual = kinds.tobytes().decode("latin-1")
    ends = list(accumulate(map(len, pattern.findall(usual))))
    if ends[-1:] == [len(text)]:
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return [text[m.start() : m.end()] for m in pattern.finditer(usual)]


# === encoding ==================================================================================


class ByteBpe:
    """Encodes and decodes by a file of ranks (a token in base64 and its rank on each line)."""

    def __init__(self, path: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        tokens = sorted(ranks, key=ranks.get)
        self.ranks, self.pattern = ranks, by_kinds(pattern)
        self.model = SentencePieceProcessor(model_proto=serialised(tokens))
        self.by_piece = np.array([*[ranks[t] for t in tokens], 0], dtype=np.uint32)
        self.known = Spellings(self._encoded)
        # Of each id its bytes, from its piece.
        spelt = [bytes(ord(c) - FIRST for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        sizes[self.by_piece[:-1]] = [len(s) for s in spelt]
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        by_id = sorted(zip(self.by_piece.tolist(), spelt, strict=False))
        self.bytes = np.frombuffer(b"".join(s for _, s in by_id), dtype=np.uint8)

    def _encoded(self, spellings: list[bytes]) -> list[np.ndarray]:
        # A spelling that is a token is that token, even where no merges lead to it.
        whole = [self.ranks.get(s) for s in spellings]
        asked = [characters(s) for s, rank in zip(spellings, whole, strict=True) if rank is None]
        pieces = iter(self.model.encode(asked, num_threads=1))
        return [
            self.by_piece[np.array(next(pieces), dtype=np.int64)] if rank is None else np.array([rank], np.uint32)
            for rank in whole
        ]

    def encode(self, texts: list[bytes]) -> pa.ListArray:
        """The ids of every text."""
        parts, counts = [], [0]
        for text in texts:
            parts += split(self.pattern, text.decode("utf-8", "replace"))
            counts.append(len(parts))
        codes = pa.array(parts, pa.string()).dictionary_encode()
        ids, sizes = self.known(codes.dictionary.cast(pa.binary()).to_pylist())
        code = codes.indices.to_numpy()
        found, ends = ragged(ids, (np.cumsum(sizes) - sizes)[code], sizes[code])
        offsets = np.concatenate([[0], ends])[counts]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.view(np.int32)))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes that every list of ids spells; null stays null. An unknown id is an error."""
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.sizes) or not self.sizes[flat].all()):
            raise ValueError("an id without a token")
        data, ends = ragged(self.bytes, self.begins[flat], self.sizes[flat])
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        buffers = [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), buffers).cast(pa.binary())
        return pc.if_else(ids.is_valid(), found, pa.scalar(None, pa.binary()))


@lru_cache(maxsize=4)
def _coder(path: str, pattern: str | None) -> ByteBpe:
    """Made once per worker; a bare file name is one of the public vocabulary package."""
    import public_tokenizers

    path = path if "/" in path else public_tokenizers.path(path)
    return ByteBpe(path, pattern or public_tokenizers.PATTERN)


# === the operator ==============================================================================


def encode(
    docs: DataFrame,
    text_col: str = "text",
    ranks: str = "byte_bpe_multi_50k.tiktoken",
    pattern: str | None = None,
    ids_col: str = "ids",
) -> DataFrame:
    """Adds `ids_col` (array of int), the token ids of every whole text.

    A null or empty text has none; bytes that are no UTF-8 count as U+FFFD. Repeated rows stay rows of
    their own, a column with the name of the added one gives way. `ranks` is a file name in the public
    vocabulary package, or a path all executors can read; `pattern` parts texts (default: the package's).
    """

    def make(texts: list[bytes]) -> dict[str, pa.Array]:
        return {ids_col: _coder(ranks, pattern).encode(texts)}

    return add_columns(docs, text_col, make, f"`{ids_col}` array<int>", TEXT_BYTES)


def decode(
    rows: DataFrame,
    ids_col: str = "ids",
    ranks: str = "byte_bpe_multi_50k.tiktoken",
    pattern: str | None = None,
    decoded_col: str = "decoded",
) -> DataFrame:
    """Adds `decoded_col` (binary), the bytes that the ids stand for; null ids give null."""
    others = without(rows, decoded_col)
    packed = rows.select(packed_columns(others), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    schema = T.StructType([packed.schema["rest"], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            block = np.cumsum(counts) // DECODED_IDS
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(counts)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                columns = [part.column(0), coder.decode(part.column(1))]
                yield pa.RecordBatch.from_arrays(columns, ["rest", "decoded"])

    found = packed.mapInArrow(run, schema)
    return found.select(*unpacked(others), F.col("decoded").alias(decoded_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decode(encode(docs).drop("text"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
