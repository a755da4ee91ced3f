"""Encoding with a SentencePiece vocabulary by the best total score, and decoding.

An Aho-Corasick automaton over the pieces reads a text once. At each position the automaton's state
and its output links name all pieces that end there, and each relaxes the best score up to the
position. Many spellings go through the automaton side by side, as columns of numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fieldtrace.llm.common import add_columns, packed_columns, ragged, table, unpacked, without

MODEL = "piece_bpe_32k.model"
# The mark that stands for a space, and what an unknown character costs beside the
# worst piece.
MARK, PENALTY = "▁", 10.0
SPACE_BYTE = 0xFF  # stands for a space; occurs in no UTF-8 text
CELLS = 1 << 19  # positions worked on at once
TEXT_BYTES = 2 << 20  # of texts encoded together


class Vocabulary:
    """The pieces of a model file, and the automaton over them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that leave texts as they are")
        self.prefix = rules.add_dummy_prefix
        library = SentencePieceProcessor(model_file=path)
        ids = range(library.get_piece_size())
        self.byte_ids = np.full(256, library.unk_id(), dtype=np.int32)
        self.spelt = [b""] * len(ids)  # what each id decodes to
        pieces: list[tuple[bytes, int, float]] = []
        for i in ids:
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.spelt[i] = bytes([int(piece[1:-1], 16)])
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.spelt[i] = piece.replace(MARK, " ").encode()
                key = b"\xff".join(p.encode() for p in piece.split(MARK))
                pieces.append((key, i, library.get_score(i)))
        self.unknown = min((p[2] for p in pieces), default=0.0) - PENALTY
        # Spaces part spellings if no piece has one behind another character.
        self.parts = all(b"\xff" not in key.lstrip(b"\xff") for key, _, _ in pieces)
        used = np.zeros(256, dtype=bool)
        used[list(set().union(*[p[0] for p in pieces]))] = True
        #: ASCII characters in no piece stand alone; texts can be cut around them.
        self.lone = ~used & (np.arange(256) < 128)
        self._automaton(pieces)
        sizes = np.array([len(s) for s in self.spelt], dtype=np.int64)
        self.spelt_sizes, self.spelt_begins = sizes, np.cumsum(sizes) - sizes
        self.spelt_data = np.frombuffer(b"".join(self.spelt), dtype=np.uint8)

    def _automaton(self, pieces: list[tuple[bytes, int, float]]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, int, float]] = {}
        levels: list[list[tuple[int, int, int]]] = []
        for key, piece, score in pieces:
            node = 0
            for depth, byte in enumerate(key):
                found = children[node].get(byte)
                if found is None:
                    found = children[node][byte] = len(children)
                    children.append({})
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((node, byte, found))
                node = found
            ends[node] = (len(key), piece, score)
        n = len(children)
        self.length, self.piece = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        self.score = np.zeros(n)
        for node, found in ends.items():
            self.length[node], self.piece[node], self.score[node] = found
        # Level by level: a node goes on as its longest shorter suffix does, but for its own children.
        own = [np.array(level).T for level in levels]
        self.next = np.zeros((n, 256), dtype=np.int32)
        fail, self.link = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        self.next[0, own[0][1]] = own[0][2]
        for depth, (_, _, nodes) in enumerate(own):
            self.next[nodes] = self.next[fail[nodes]]
            if depth + 1 < len(own):
                parents, bytes_, below = own[depth + 1]
                fail[below] = self.next[fail[parents], bytes_]
                self.next[parents, bytes_] = below
            self.link[nodes] = np.where(self.length[fail[nodes]] > 0, fail[nodes], self.link[fail[nodes]])

    # --- one group of spellings ---------------------------------------------------------------

    def best(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best pieces of `data[start:start + size]`, in a row, and how many each has.

        Sizes must not rise. The best total score wins; of equal ones the longest last piece.
        """
        n, width = len(starts), int(sizes[0])
        inside = np.arange(width)[None, :] < sizes[:, None]
        at = np.where(inside, starts[:, None] + np.arange(width)[None, :], 0)
        text = np.where(inside, data[at], 0)
        score = np.full((n, width + 1), -np.inf)
        score[:, 0] = 0
        size, piece = np.ones((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        state, begun = np.zeros(n, np.int32), np.zeros(n, np.int64)
        follows = (text & 0xC0) == 0x80
        alive = np.searchsorted(-sizes, -np.arange(width), "left")  # rows longer than t
        for t in range(width):
            m = int(alive[t])
            byte = text[:m, t]
            state[:m] = self.next[state[:m], byte]
            begun[:m][~follows[:m, t]] = t
            now, single = score[:m, t + 1], np.zeros(m, dtype=bool)
            node = np.where(self.length[state[:m]] > 0, state[:m], self.link[state[:m]])
            rows = np.flatnonzero(node)
            node = node[rows]
            while len(rows):
                length = self.length[node]
                total = score[rows, t + 1 - length] + self.score[node]
                better = total > now[rows]
                won = rows[better]
                now[won] = total[better]
                size[won, t + 1], piece[won, t + 1] = length[better], self.piece[node[better]]
                single[rows[length == t + 1 - begun[rows]]] = True
                node = self.link[node]
                more = node > 0
                rows, node = rows[more], node[more]
            last = sizes[:m] == t + 1
            over = last if t + 1 == width else last | ~follows[:m, t + 1]
            rows = np.flatnonzero(over & ~single)
            total = score[rows, begun[rows]] + self.unknown
            won = rows[total > now[rows]]
            now[won] = total[total > now[rows]]
            size[won, t + 1], piece[won, t + 1] = 1, -1
        # Back from the ends; an unknown character gives its bytes one by one.
        found, filled = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        place, rows = sizes.copy(), np.arange(n)
        while len(rows):
            own = piece[rows, place[rows]]
            byte = text[rows, place[rows] - 1]
            found[rows, width - 1 - filled[rows]] = np.where(own < 0, self.byte_ids[byte], own)
            filled[rows] += 1
            place[rows] -= size[rows, place[rows]]
            rows = rows[place[rows] > 0]
        return found[np.arange(width)[None, :] >= width - filled[:, None]], filled

    # --- texts --------------------------------------------------------------------------------

    SPACED = bytes(SPACE_BYTE if b == 32 else b for b in range(256))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. Equal spellings are worked out once."""
        lead = bytes([SPACE_BYTE]) if self.prefix else b""
        spaced = [lead + t.translate(self.SPACED) if t else b"" for t in texts]
        sizes = np.array([len(t) for t in spaced], dtype=np.int64)
        data = np.frombuffer(b"".join(spaced), dtype=np.uint8)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        cut = np.zeros(len(data) + 1, dtype=bool)
        begins = np.cumsum(sizes) - sizes
        cut[begins] = True
        if self.parts:
            space = data == SPACE_BYTE
            cut[1:-1] |= space[1:] & ~space[:-1]
        lone = self.lone[data]
        cut[:-1] |= lone
        cut[1:] |= lone
        cut[-1] = False
        offsets = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        spellings = pa.Array.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        ids, counts = self._distinct(spellings.dictionary)
        code = spellings.indices.to_numpy()
        found, ends = ragged(ids, (np.cumsum(counts) - counts)[code], counts[code])
        before = np.append(0, ends)[np.searchsorted(offsets, np.append(begins, len(data)))]
        return found, np.diff(before)

    def _distinct(self, spellings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(spellings.buffers()[1], dtype=np.int32)[: len(spellings) + 1].astype(np.int64)
        data = np.frombuffer(spellings.buffers()[2], dtype=np.uint8)
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        parts, counts, start = [], np.zeros(len(sizes), np.int64), 0
        while start < len(order):
            rows = order[start : start + max(1, CELLS // max(1, int(sizes[order[start]])))]
            ids, counts[rows] = self.best(data, offsets[rows], sizes[rows])
            parts.append(ids)
            start += len(rows)
        # From the order of sizes back to the order of the spellings.
        ids = np.concatenate(parts)
        begins = np.zeros(len(sizes), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return ragged(ids, begins, counts)[0], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of rows of ids: `counts` says how many each has."""
        data, ends = ragged(self.spelt_data, self.spelt_begins[ids], self.spelt_sizes[ids])
        cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        whole, skip = data.tobytes(), 1 if self.prefix else 0
        return [
            whole[a + skip : b] if skip and whole[a : a + 1] == b" " else whole[a:b]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]


_known: dict[str, Vocabulary] = {}


def vocabulary(name: str = MODEL) -> Vocabulary:
    """The vocabulary of a file of the public package, or of a path; loaded once per process."""
    if name not in _known:
        import public_tokenizers

        _known[name] = Vocabulary(name if "/" in name else public_tokenizers.path(name))
    return _known[name]


def encode(
    docs: DataFrame, text_col: str = "text", model: str = MODEL, with_decoded: bool = False
) -> DataFrame:
    """`docs` with ids (array<int>) and n_tokens of whole texts; columns of those names give way.

    Empty and null texts have no ids. Any text comes back exactly from `decode`: the mark that stands
    for a space is, as a character of a text, spelt in bytes. `with_decoded` adds what the ids decode
    to, worked out by the same task.
    """

    def make(texts: list[bytes]) -> dict[str, pa.Array]:
        ids, counts = vocabulary(model).encode(texts)
        offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
        found = {
            "ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
            "n_tokens": pa.array(counts, pa.int64()),
        }
        if with_decoded:
            back = vocabulary(model).decode(ids, counts)
            found["decoded"] = pa.array(back, pa.binary()).cast(pa.string())
        return found

    added = "ids array<int>, n_tokens long" + (", decoded string" if with_decoded else "")
    return add_columns(docs, text_col, make, added, TEXT_BYTES)


def decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """`tokens` with the texts of its ids. Null ids give an empty text; null entries count as id 0."""
    others = without(tokens, out_col)
    packed = tokens.select(
        packed_columns(others),
        F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            counts = pc.list_value_length(ids).to_numpy()
            texts = vocabulary(model).decode(ids.flatten().fill_null(0).to_numpy(), counts)
            found = pa.array([t.decode(errors="replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch["rest"], found], ["rest", "decoded"])

    schema = T.StructType([packed.schema["rest"], T.StructField("decoded", T.StringType())])
    found = packed.mapInArrow(run, schema)
    return found.select(*unpacked(others), F.col("decoded").alias(out_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, the text's digest, and whether the ids give the whole text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return encode(docs, with_decoded=True).select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2(F.encode(text, "utf-8"), 256).alias("text_sha256"),
        (F.col("decoded") == text).alias("round_trip"),
    )
