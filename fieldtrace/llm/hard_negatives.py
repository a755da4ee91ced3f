"""Hard negatives of anchors: rows of another label that score high, but not as high as a positive.

Scores are inner products of integer vectors, exact. Anchors are written in slices to the shared folder;
every task reads its rows once, in blocks, and multiplies each block with one slice after the other by
Strassen's recursion. Of a product only heaps stay: of each anchor the best rows of its own label, then of
each anchor and positive the best rows in the positive's window. Heaps of tasks merge into heaps of some
tasks and then of all. So rows are never shuffled, and what is shuffled is heaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldtrace.llm.common import filesystem, table, written_files

SCALE = 256
LEAF = 24  # products with a side of at most this are taken directly
SLICE_ROWS = 2048  # anchors of a slice
BLOCK_NUMBERS = 1 << 23  # vector components of rows that a task holds
TILE = 1 << 21  # scores worked on at once
MERGED = 64  # tasks whose heaps merge first
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which sorts last


# === exact products ============================================================================


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices with seven products of halves in place of eight.

    Sides of odd length get a row or column of zeros. Only sums and products of integers occur, so the
    result is exact whenever its entries fit into 64 bits.
    """
    m, d, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, d, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m & 1), (0, d & 1)))
    b = np.pad(b, ((0, d & 1), (0, n & 1)))
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    found = np.empty((2 * i, 2 * k), dtype=np.int64)
    found[:i, :k] = p1 + p4 - p5 + p7
    found[:i, k:] = p3 + p5
    found[i:, :k] = p2 + p4
    found[i:, k:] = p1 - p2 + p3 + p6
    return found[:m, :n]


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    found[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return found


# === heaps =====================================================================================


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `k` highest allowed scores of each row; equal ones by the smaller column."""
    n = scores.shape[1]
    spread = max(abs(int(scores.max(initial=0))), abs(int(scores.min(initial=0)))) + 1
    if spread * n >= 1 << 62:  # then only the order of scores counts
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    # No two keys of a row are equal, so exactly the best are at or above the k-th.
    keys = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), np.iinfo(np.int64).min)
    if n > k:
        least = np.partition(keys, n - k, axis=1)[:, n - k]
        allowed = allowed & (keys >= least[:, None])
    return np.nonzero(allowed)


class Heaps:
    """Bounded heaps, one for each owner: the `k` rows with the highest scores, ties by smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.empty((0, 3), dtype=np.int64)  # owner, score, id; in order

    def merge(self, owners: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([owners, scores, ids], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0], "left")
        self.rows = rows[np.arange(len(rows)) - first < self.k]


def merged(heaps: DataFrame, keys: list[str], score: str, row_id: str, k: int) -> DataFrame:
    """Heaps of tasks as heaps of all, with `rank` from 1: those of MERGED tasks first."""

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(row_id))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    tasks = (F.spark_partition_id() / MERGED).cast("int")
    return cut(cut(heaps.withColumn("tasks", tasks), *keys, "tasks").drop("tasks", "rank"), *keys)


# === tiles =====================================================================================


def vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
) -> DataFrame:
    """`(id, label, vector)` of the rows that take part: components times `scale`, rounded down.

    Rows with a null label, a null vector or a null or non-finite component do not. A component beyond
    64 bits is an error, as are scores beyond them.
    """
    whole = F.col(f"`{vector_col}`").cast("array<double>")

    def fine(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return rows.where(
        F.col(f"`{label_col}`").isNotNull() & whole.isNotNull() & F.forall(whole, fine)
    ).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        F.transform(whole, lambda x: F.floor(x * scale).cast("long")).alias("vector"),
    )


def _slices(files: list[str]) -> Iterator[pa.RecordBatch]:
    for path in files:
        system, inner = filesystem(path)
        with system.open_input_file(inner) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=SLICE_ROWS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Ids, labels and vectors of many rows together, in the order of ids, bounded by components."""
    held, size = [], 0

    def block() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        rows = pa.Table.from_batches(held)
        ids = rows["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        take = pa.array(order)
        labels = rows["label"].combine_chunks().to_numpy(zero_copy_only=False)
        return ids[order], labels[order], rows["vector"].combine_chunks().take(take)

    for batch in batches:
        if held and size + len(batch.column("vector").flatten()) > BLOCK_NUMBERS:
            yield block()
            held, size = [], 0
        held.append(batch)
        size += len(batch.column("vector").flatten())
    if held:
        yield block()


def _width(*columns: pa.Array) -> int:
    return max([1, *[pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns]])


def _product(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of a tile; an error if they may not fit into 64 bits."""
    top = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (anchors, rows)]
    if top[0] * top[1] * anchors.shape[1] >= 1 << 63:
        raise OverflowError("scores beyond 64 bits")
    return strassen(anchors, np.ascontiguousarray(rows).T)


def _tiles(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """The scores of all anchors with all rows, tile by tile."""
    step = max(LEAF, TILE // max(1, min(len(anchors), 512)))
    for i in range(0, len(anchors), 512):
        for j in range(0, len(rows), step):
            a, b = slice(i, min(i + 512, len(anchors))), slice(j, min(j + step, len(rows)))
            yield a, b, _product(anchors[a], rows[b])


# === the operator ==============================================================================


def _positives(rows: DataFrame, files: list[str], k: int) -> DataFrame:
    """Of every anchor the best other rows of its label: key, positive_id, positive_score, rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors_ in _blocks(batches):
            for anchors in _slices(files):
                width = _width(vectors_, anchors["vector"])
                a, b = _padded(anchors["vector"], width), _padded(vectors_, width)
                keys, a_ids, a_labels = (anchors[c].to_numpy(zero_copy_only=False) for c in ("key", "id", "label"))
                heaps = Heaps(k)
                # Rows of one label meet the anchors of that label only.
                for label in np.intersect1d(a_labels, labels):
                    mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
                    for x, y, scores in _tiles(a[mine], b[theirs]):
                        own, near = mine[x], theirs[y]
                        i, j = best(scores, a_ids[own, None] != ids[None, near], k)
                        heaps.merge(keys[own[i]], scores[i, j], ids[near[j]])
                key, score, row_id = heaps.rows.T
                yield pa.RecordBatch.from_pydict(
                    {"key": key, "positive_id": _nullable(row_id), "positive_score": score}
                )

    found = rows.mapInArrow(run, "key long, positive_id long, positive_score long")
    return merged(found, ["key"], "positive_score", "positive_id", k)


def _nullable(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NO_ID)


def _window(score: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest integer between two fractions of a score, without overflow."""

    def floor(x: np.ndarray, part: tuple[int, int]) -> np.ndarray:
        return x // part[1] * part[0] + x % part[1] * part[0] // part[1]

    return -floor(-score, low), floor(score, high)


def _negatives(rows: DataFrame, files: list[str], k: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Of every anchor and positive the best rows of other labels in the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors_ in _blocks(batches):
            for anchors in _slices(files):
                width = _width(vectors_, anchors["vector"])
                a, b = _padded(anchors["vector"], width), _padded(vectors_, width)
                keys, a_labels = (anchors[c].to_numpy(zero_copy_only=False) for c in ("key", "label"))
                scores_of = _padded(anchors["scores"], n_places := _width(anchors["scores"]))
                n_of = pc.list_value_length(anchors["scores"]).to_numpy()
                least, most = _window(scores_of, low, high)
                heaps = Heaps(k)
                for x, y, scores in _tiles(a, b):
                    other = a_labels[x, None] != labels[None, y]
                    for place in range(n_places):
                        inside = other & (scores >= least[x, place, None]) & (scores <= most[x, place, None])
                        inside &= (n_of[x] > place)[:, None]
                        i, j = best(scores, inside, k)
                        owner = keys[x][i] * n_places + place
                        heaps.merge(owner, scores[i, j], ids[y][j])
                owner, score, row_id = heaps.rows.T
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": owner // n_places,
                        "place": (owner % n_places).astype(np.int32),
                        "negative_id": _nullable(row_id),
                        "negative_score": score,
                    }
                )

    found = rows.mapInArrow(run, "key long, place int, negative_id long, negative_score long")
    return merged(found, ["key", "place"], "negative_score", "negative_id", k)


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: tuple[int, int] = (3, 10),
    high: tuple[int, int] = (9, 10),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` and `anchors` are tables as `vectors` makes them. Of every anchor the `positives` best rows of
    its label with another id; for each of them the `negatives` best rows of other labels whose score
    lies between the fractions `low` and `high` of the positive's score. Higher scores come first, ties go
    by the smaller id, a null id last. Shorter vectors end in zeros. Repeated rows are rows of their own,
    repeated anchors too; anchors without positives, and positives without negatives, have no row.
    """
    spark = rows.sparkSession
    # Keys are fixed once they are written.
    numbered, files = written_files(anchors.withColumn("key", F.monotonically_increasing_id()), "anchors")
    found = _positives(rows, files, positives)
    lists = found.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p")
    )  # of at most `positives` rows
    listed = numbered.join(lists, "key").withColumn("scores", F.col("p.positive_score"))
    asked, files = written_files(listed, "asked")
    hits = _negatives(rows, files, negatives, low, high)
    pairs = asked.select("key", F.col("id").alias("anchor_id"), F.posexplode("p").alias("place", "p"))
    return hits.join(pairs, ["key", "place"]).select(
        "anchor_id", "p.positive_id", "rank", "negative_id", "p.positive_score", "negative_score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    mended = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    found = vectors(mended)
    return mine(found, found.where(F.col("id") % 100 == 0))


SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
        list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
    from v a, v b where a.vec_id % 100 = 0
), p as (
    select anchor_id, id as positive_id, score as positive_score from s where same and id <> anchor_id
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, positive_score, s.id as negative_id, s.score as negative_score,
    (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id))::integer as rank
from p join s on p.anchor_id = s.anchor_id and not same
    and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) <= 10
"""
