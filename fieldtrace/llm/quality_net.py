"""Quality of texts by a small convolutional network over bytes, in numpy.

Every byte becomes a short learned vector; one more number says whether its word repeats the word before.
Learned filters look at chunks of 64 bytes that overlap by half and cover the whole text, the largest
answer of each filter over all chunks is kept, and these are weighed together to one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrace.llm.common import add_columns, table
from fieldtrace.llm.hashing import IS_SPACE, RangeHash

BLOCK = 32  # half a chunk
BYTE_SIZE, FILTERS = 7, 24
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 65_536  # of each label, and in a text, to learn from
EPOCHS, BATCH, RATE, DECAY, SEED = 10, 32, 0.004, 1e-4, 7
FOLDS, KEEP = 5, 0.3
_WORDS = RangeHash(41)


# === bytes to blocks ===========================================================================


def _repeats(data: np.ndarray) -> np.ndarray:
    """1 at bytes of words that equal the word before in the same text (texts end with a zero byte)."""
    space = IS_SPACE[data] | (data == 0)
    edges = np.diff(space.view(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(len(data), np.float32)
    found = _WORDS(data, starts, ends)
    zeros = np.concatenate([[0], np.cumsum(data == 0)])
    same = np.zeros(len(starts), dtype=np.int8)
    same[1:] = (found[1:] == found[:-1]) & (zeros[starts[1:]] == zeros[starts[:-1]])
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts], marks[ends] = same, -same
    return np.cumsum(marks[:-1]).astype(np.float32)


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in whole blocks, their repeat marks, and how many blocks each text has.

    A block of zeros ends every text, so that each of its blocks begins a chunk.
    """
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], dtype=np.int64)
    data = b"".join(
        t.replace(b"\0", b" ").ljust(int(n + 1) * BLOCK, b"\0") for t, n in zip(texts, blocks, strict=True)
    )
    found = np.frombuffer(data, dtype=np.uint8)
    return found, _repeats(found), blocks


# === the network ===============================================================================


@dataclass
class Net:
    """Learned numbers: byte vectors, two halves of the filters, their biases, the last layer."""

    bytes_: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, seed: int = SEED) -> Net:
        random = np.random.default_rng(seed)
        width = BLOCK * (BYTE_SIZE + 1)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        vectors = draw(256, BYTE_SIZE, scale=0.5)
        vectors[0] = 0
        halves = (draw(width, FILTERS, scale=width**-0.5) for _ in range(2))
        zeros = np.zeros(FILTERS, np.float32), np.zeros(1, np.float32)
        return cls(vectors, *halves, zeros[0], draw(FILTERS, scale=FILTERS**-0.5), zeros[1])

    def parts(self) -> list[np.ndarray]:
        return [self.bytes_, self.first, self.second, self.bias, self.out, self.out_bias]

    def _inputs(self, data: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        inputs = np.empty((len(data), BYTE_SIZE + 1), np.float32)
        inputs[:, :BYTE_SIZE] = self.bytes_[data]
        inputs[:, BYTE_SIZE] = repeats
        return inputs.reshape(len(data) // BLOCK, -1)

    def _chunks(self, inputs: np.ndarray) -> np.ndarray:
        found = inputs @ self.first
        found[:-1] += inputs[1:] @ self.second
        return found + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of quality 1 of each text."""
        data, repeats, blocks = layout(texts)
        chunks = self._chunks(self._inputs(data, repeats))
        begins = np.cumsum(blocks + 1) - blocks - 1
        chunks[begins + blocks] = -np.inf  # the block of zeros
        best = np.maximum.reduceat(chunks, begins, axis=0)
        total = np.maximum(best, 0).astype(np.float64) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss. Only the chunks that won the pooling are followed back."""
        data, repeats, blocks = layout(texts)
        inputs = self._inputs(data, repeats)
        chunks = self._chunks(inputs)
        begins = np.cumsum(blocks + 1) - blocks - 1
        n = len(texts)
        winner = np.stack([b + chunks[b : b + k].argmax(axis=0) for b, k in zip(begins, blocks, strict=True)])
        best = np.take_along_axis(chunks, winner, axis=0)
        active = np.maximum(best, 0)
        chance = 1 / (1 + np.exp(-np.clip(active @ self.out + self.out_bias, -50, 50)))
        off = ((chance - labels) / n).astype(np.float32)
        back = off[:, None] * self.out[None, :] * (best > 0)
        left, right = inputs[winner], inputs[winner + 1]  # texts x filters x width
        grad_first = np.einsum("tf,tfw->wf", back, left)
        grad_second = np.einsum("tf,tfw->wf", back, right)
        grad_bytes = np.zeros_like(self.bytes_)
        places = data.reshape(-1, BLOCK)
        for half, weights in ((winner, self.first), (winner + 1, self.second)):
            shaped = weights.T.reshape(FILTERS, BLOCK, BYTE_SIZE + 1)[:, :, :BYTE_SIZE]
            at = places[half].reshape(-1)
            np.add.at(grad_bytes, at, (back[:, :, None, None] * shaped[None]).reshape(-1, BYTE_SIZE))
        grad_bytes[0] = 0
        return [grad_bytes, grad_first, grad_second, back.sum(0), off @ active, np.array([off.sum()])]


def learn(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """A network fitted by Adam in a fixed order of batches; without both labels, one that says 0.5."""
    net = Net.new(seed)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    random = np.random.default_rng(seed)
    parts = net.parts()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = random.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            step += 1
            found = net.gradients([texts[i] for i in rows], labels[rows])
            for part, grad, m, v in zip(parts, found, first, second, strict=True):
                grad = grad + DECAY * part
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.bytes_[0] = 0
    return net


# === the operator ==============================================================================


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is left out of learning: crc32 of its id as text is a multiple of 5."""
    crc = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    return F.coalesce(crc % FOLDS == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> Net:
    """A network fitted on a sample of the labelled rows that are not held out.

    `rows` of each label, by a hash of their id, without texts longer than `chars`: at most 2 * rows *
    chars characters come to the driver, whatever the tables hold. An id with several labels counts by
    the lowest; null labels, ids and texts are left out, and rows that repeat an id count as one.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    chosen = [known.where(F.col("label") == x).orderBy(F.xxhash64("id"), "id").limit(rows) for x in (0, 1)]
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sample = sample.where(F.length("text") <= chars).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "id"
    )
    sample = sample.groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda r: r.id)
    return learn([r.text.encode() for r in sample], np.array([r.label for r in sample], dtype=np.float32))


def classify(docs: DataFrame, net: Net, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with score: the probability of quality 1, from nothing but the whole text.

    Null and empty texts are scored as an empty text. A column named as the score gives way.
    """

    def make(texts: list[bytes]) -> dict[str, pa.Array]:
        return {score_col: pa.array(net.scores(texts), pa.float64())}

    return add_columns(docs, text_col, make, f"`{score_col}` double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, net).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= KEEP).cast("int").alias("predicted"),
    )
