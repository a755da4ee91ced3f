"""Dropping lines that many documents share.

Distinct line hashes are counted over all documents. The frequent ones go, by a prefix of their hash, to
shards; each shard gets a minimal perfect hash, and arrays of fingerprints, counts and keepers in the
order it gives. The arrays are files in the shared work folder. Documents probe them where they stand:
no line is joined, and no text is shuffled.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.llm.common import add_columns, blocks, filesystem, new_folder, table, without, written
from fieldtrace.llm.hashing import IS_SPACE, LOWER, RangeHash, U64, mix

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_LINES = 50_000  # distinct frequent lines in a shard, on average
CACHE_BYTES = 256 << 20  # of arrays a Python worker keeps
NO_ID = np.iinfo(np.int64).min  # a null id, below all others
_FIRST, _SECOND = RangeHash(21), RangeHash(31)


# === lines of a block ==========================================================================


class Lines:
    """All lines of some texts: where they lie, whose they are, and the hashes of the long ones' keys."""

    def __init__(self, texts: list[bytes], min_chars: int):
        self.data = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.data, dtype=np.uint8)
        breaks = np.flatnonzero(data == 10)
        self.starts, self.ends = np.concatenate([[0], breaks[:-1] + 1]), breaks
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, begins)  # of each text; one more at the end
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        solid = np.flatnonzero(~IS_SPACE[data])
        low = np.searchsorted(solid, self.starts)
        high = np.searchsorted(solid, self.ends)
        some = np.flatnonzero(high > low)
        starts, ends = solid[low[some]], solid[high[some] - 1] + 1
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = chars[ends] - chars[starts] >= min_chars
        self.long, starts, ends = some[long], starts[long], ends[long]
        lower = LOWER[data]
        self.h1, self.h2 = _FIRST(lower, starts, ends), _SECOND(lower, starts, ends)


# === minimal perfect hash ======================================================================


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of bits for distinct 64-bit keys.

    On each level a key hashes to one of twice as many bits as keys are left; the keys alone on their bit
    set it, the others go on. The number of bits set before a key's own bit is its place among all keys.
    """
    levels, rest = [], keys
    while len(rest):
        at = _place(rest, len(levels), 2 * len(rest))
        alone = np.bincount(at, minlength=2 * len(rest)) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
    return levels


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 1, dtype=U64))) % U64(size)).astype(np.int64)


def look_up(levels: list[np.ndarray], ranks: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The place of each key; of one that is not in the set, the place of some other key, or -1."""
    found = np.full(len(keys), -1, dtype=np.int64)
    rest = np.arange(len(keys))
    for level, (bits, rank) in enumerate(zip(levels, ranks, strict=True)):
        at = _place(keys[rest], level, len(bits))
        hit = bits[at]
        found[rest[hit]] = rank[at[hit]]
        rest = rest[~hit]
    return found


class Shard:
    """Arrays of one shard, as read from its file."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as found:
            n = int(found["n_levels"])
            self.levels = [
                np.unpackbits(found[f"bits{i}"], count=int(found["sizes"][i])).astype(bool) for i in range(n)
            ]
            self.prints, self.counts, self.keepers = found["prints"], found["counts"], found["keepers"]
        self.ranks, before = [], 0
        for bits in self.levels:
            self.ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())
        self.bytes = sum(9 * len(b) for b in self.levels) + 24 * len(self.prints)

    def keeper(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the lines are in the shard, and the document that keeps them."""
        at = look_up(self.levels, self.ranks, h1)
        known = at >= 0
        known[known] = self.prints[at[known]] == h2[known]
        return known, self.keepers[np.where(known, at, 0)] if len(self.keepers) else at


def shard_bytes(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> bytes:
    """The file of a shard. Lines are told apart by both hashes, 128 bits in all; should two share the
    first, 64 bits, the second goes by the others' fingerprint, so such lines must be split before."""
    levels = perfect_hash(h1)
    ranks, before = [], 0
    for bits in levels:
        ranks.append(before + np.cumsum(bits) - bits)
        before += int(bits.sum())
    order = np.argsort(look_up(levels, ranks, h1))
    out = io.BytesIO()
    np.savez(
        out, n_levels=len(levels), sizes=np.array([len(b) for b in levels]), prints=h2[order],
        counts=counts[order], keepers=keepers[order],
        **{f"bits{i}": np.packbits(bits) for i, bits in enumerate(levels)},
    )
    return out.getvalue()


# === the operator ==============================================================================


def line_counts(
    docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Hashes (h1, h2) of the keys in at least `min_docs` documents, n_docs, and the largest id."""

    def found(batches):
        for rows, texts in blocks(batches, "text"):
            lines = Lines(texts, min_chars)
            ids = rows["id"].fill_null(NO_ID).to_numpy()
            each = pd.DataFrame(
                {"h1": lines.h1.view(np.int64), "h2": lines.h2.view(np.int64), "row": lines.owner[lines.long]}
            ).drop_duplicates()
            each["id"] = ids[each.pop("row")]
            yield pa.RecordBatch.from_pandas(each, preserve_index=False)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return (
        narrow.mapInArrow(found, "h1 long, h2 long, id long")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )


class Files(NamedTuple):
    """Where the shards lie: `folder/number.part`."""

    folder: str
    n_shards: int
    n_parts: int


def build_index(counts: DataFrame, shard_lines: int = SHARD_LINES) -> Files:
    """Writes the shards of a line_counts table to a new folder."""
    held = written(counts, "line-counts")
    n_shards = max(1, -(-held.count() // shard_lines))
    folder = new_folder(held.sparkSession, "line-index")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h1", "h2"])
        # Equal first hashes of different lines: all but the first go to a list of their own.
        extra = rows["h1"].duplicated().to_numpy()
        parts = [rows[~extra]] + [rows.iloc[[i]] for i in np.flatnonzero(extra)]
        system, inner = filesystem(folder)
        for part, own in enumerate(parts):
            data = shard_bytes(
                own["h1"].to_numpy().view(U64), own["h2"].to_numpy().view(U64),
                own["n_docs"].to_numpy(), own["keeper"].to_numpy(),
            )
            # A task that runs twice writes the same bytes; the rename shows them whole.
            path = f"{inner}/{key[0]}.{part}"
            temporary = f"{path}.{np.random.default_rng().integers(1 << 62)}"
            with system.open_output_stream(temporary, compression=None) as out:
                out.write(data)
            system.move(temporary, path)
        return pd.DataFrame({"shard": [key[0]], "parts": [len(parts)]})

    shard = F.pmod(F.shiftrightunsigned("h1", 32), F.lit(n_shards)).cast("int")
    built = held.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard int, parts int")
    return Files(folder, n_shards, built.agg(F.max("parts")).first()[0] or 0)


class Index:
    """The shards of a folder, read when they are first asked and kept up to a number of bytes."""

    def __init__(self, files: Files):
        self.system, self.inner = filesystem(files.folder)
        self.files = files
        self.kept: OrderedDict[str, Shard | None] = OrderedDict()

    def shard(self, name: str) -> Shard | None:
        if name not in self.kept:
            path = f"{self.inner}/{name}"
            if self.system.get_file_info(path).is_file:
                with self.system.open_input_file(path) as file:
                    self.kept[name] = Shard(file.read())
            else:
                self.kept[name] = None
        self.kept.move_to_end(name)
        while len(self.kept) > 1 and sum(s.bytes for s in self.kept.values() if s) > CACHE_BYTES:
            self.kept.popitem(last=False)
        return self.kept[name]

    def keepers(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, keepers = np.zeros(len(h1), dtype=bool), np.zeros(len(h1), dtype=np.int64)
        own = ((h1 >> U64(32)) % U64(self.files.n_shards)).astype(np.int64)
        for number in np.unique(own):
            at = np.flatnonzero(own == number)
            for part in range(self.files.n_parts):
                shard = self.shard(f"{number}.{part}")
                if shard is not None:
                    hit, keeper = shard.keeper(h1[at], h2[at])
                    known[at[hit]], keepers[at[hit]] = True, keeper[hit]
        return known, keepers


def drop_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """`docs` with the text without shared lines, n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z as a-z. Keys of `min_chars` code points
    found in `min_docs` rows lose all their lines but those of the rows with the largest id that holds
    them. A null text is one empty line and comes back empty; a null id is below all others, and rows that
    share an id count singly and keep alike. Columns named n_lines or n_dropped are replaced; all others
    stay.
    """
    files = build_index(line_counts(docs, id_col, text_col, min_chars, min_docs))
    index: list[Index] = []  # one per task

    def probe(texts: list[bytes], ids: pa.ChunkedArray) -> dict[str, pa.Array]:
        if not index:
            index.append(Index(files))
        lines = Lines(texts, min_chars)
        own = ids.fill_null(NO_ID).to_numpy()
        known, keeper = index[0].keepers(lines.h1, lines.h2)
        gone = np.zeros(len(lines.starts), dtype=bool)
        gone[lines.long] = known & (keeper != own[lines.owner[lines.long]])
        dropped = np.bincount(lines.owner[gone], minlength=len(texts))
        kept = [text if not dropped[i] else _rest(lines, gone, i) for i, text in enumerate(texts)]
        return {
            text_col: pa.array(kept, pa.binary()).cast(pa.string()),
            "n_lines": pa.array(np.diff(lines.first), pa.int64()),
            "n_dropped": pa.array(dropped, pa.int64()),
        }

    added = f"`{text_col}` string, n_lines long, n_dropped long"
    found = add_columns(docs, text_col, probe, added, given=F.col(f"`{id_col}`").cast("long"))
    columns = [f"`{c}`" for c in without(docs, "n_lines", "n_dropped")]
    return found.select(*columns, "n_lines", "n_dropped")


def _rest(lines: Lines, gone: np.ndarray, text: int) -> bytes:
    own = range(lines.first[text], lines.first[text + 1])
    return b"\n".join(lines.data[lines.starts[i] : lines.ends[i]] for i in own if not gone[i])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256")
    )


# Spark's and DuckDB's regular expressions agree on these classes.
SQL = rf"""
with lines as (
  select doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
        from documents)),
frequent as (
  select key, max(doc_id) as keeper from lines where length(key) >= {MIN_CHARS}
  group by key having count(distinct doc_id) >= {MIN_DOCS}),
marked as (
  select l.*, f.key is not null and f.keeper <> l.doc_id as gone
  from lines l left join frequent f on l.key = f.key)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id"""
