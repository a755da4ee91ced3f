"""A trained neighbour index: k-means partitions with product-quantised residual codes.

Of every vector the index keeps a short code, from which it can be rebuilt nearly, and how far the rebuilt
vector is from it. By the triangle inequality the true distance lies within that error of the distance to
the rebuilt one. So a search reads codes, takes the k-th smallest upper bound as its limit, and reads only
vectors whose lower bound is within it: no neighbour is missed among the rows looked at, and most vectors
are never read. A partition is looked at while its ball of rows is not provably farther than the limit.

Tables in the index's folder: `centroids`, `books` (small, written once by `train`), and per partition
`codes` and `vectors`, to which `add` appends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from fieldtrace import fixed
from fieldtrace.operators.knn import (
    DIGITS,
    METRICS,
    _Nearest,
    _matrix,
    _ranked,
    _unit,
    _vectors,
    check_k,
)
from fieldtrace.session import hold, small

SAMPLE_ROWS = 65_536  # what a model is fitted on at most
PARTITIONS = 64
CODE_BYTES = 32  # parts a residual is cut into, one byte each
ROUNDS = 12  # of k-means
SLACK = 2 * 10.0**-DIGITS  # distances are rounded before they are compared
BLOCK_ROWS = 4096
ASK_ROWS = 1024  # queries that meet a block at once
PAIRS = 1 << 15  # vectors that are compared at once
ASK_BYTES = 4 << 20  # of queries that go through the driver at once, it has them several times


# === fitting ===================================================================================


def _means(points: np.ndarray, k: int) -> np.ndarray:
    """Centres by Lloyd's rounds, from points chosen by a fixed seed. Fewer points are their own centres."""
    points = points.reshape(len(points), -1)
    if len(points) <= k:
        return points
    centres = points[np.sort(np.random.default_rng(7).choice(len(points), k, replace=False))]
    for _ in range(ROUNDS):
        at = _nearest_centre(points, centres)
        sizes = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    found = np.empty(len(points), dtype=np.int64)
    size = (centres * centres).sum(1)
    for start in range(0, len(points), BLOCK_ROWS):
        block = points[start : start + BLOCK_ROWS]
        found[start : start + BLOCK_ROWS] = (size - 2 * block @ centres.T).argmin(1)
    return found


def _cuts(dim: int, n: int) -> list[int]:
    return [dim * i // n for i in range(n + 1)]


class Model:
    """Centres of partitions, and for each part of a residual its book of 256 entries at most."""

    def __init__(self, metric: str, centroids: np.ndarray, books: list[np.ndarray]):
        self.metric, self.centroids, self.books = metric, centroids, books
        self.cuts = _cuts(centroids.shape[1], len(books))

    def placed(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros((0, self.centroids.shape[1]))
        matrix = _matrix(column)
        if matrix.shape[1] != self.centroids.shape[1]:
            raise ValueError(f"vectors of length {matrix.shape[1]}, index of length {self.centroids.shape[1]}")
        return _unit(matrix) if self.metric == "cosine" else matrix

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Partition, code, error and distance to the partition's centre of each row."""
        part = _nearest_centre(rows, self.centroids)
        rest = rows - self.centroids[part]
        codes = np.empty((len(rows), len(self.books)), dtype=np.uint8)
        for i, book in enumerate(self.books):
            codes[:, i] = _nearest_centre(rest[:, self.cuts[i] : self.cuts[i + 1]], book)
        error = np.linalg.norm(rows - self.rebuilt(part, codes), axis=1)
        return part, codes, error, np.linalg.norm(rest, axis=1)

    def measure(self, length: np.ndarray) -> np.ndarray:
        """A length as the metric has it; of unit vectors, the cosine distance is half the square."""
        return length**2 / 2 if self.metric == "cosine" else length**2

    def rebuilt(self, part: np.ndarray, codes: np.ndarray) -> np.ndarray:
        rest = [book[codes[:, i]] for i, book in enumerate(self.books)]
        return self.centroids[part] + np.concatenate(rest, axis=1)


def train(
    rows: DataFrame,
    folder: str,
    metric: str = "cosine",
    partitions: int = PARTITIONS,
    code_bytes: int = CODE_BYTES,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "id",
    vector_col: str = "embedding",
) -> Index:
    """Fits a model and writes it; the index is empty until `add`.

    The fit sees the `sample_rows` rows with the smallest hash of their vector, a bounded sample; the index
    then takes every row. Partitions are fitted in one task, the books of all parts side by side.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = rows.sparkSession
    seen = _vectors(rows, id_col, vector_col, "id").select("embedding")
    sample = hold(seen.orderBy(F.xxhash64("embedding"), "embedding").limit(sample_rows))
    if sample.isEmpty():
        raise ValueError("no vectors to fit on")

    def points(column: pa.Array) -> np.ndarray:
        matrix = _matrix(column)
        return _unit(matrix) if metric == "cosine" else matrix

    def centres(table: pa.Table) -> pa.Table:
        found = _means(points(table["embedding"]), partitions)
        return pa.table({"part": pa.array(range(len(found)), pa.int32()), "centre": pa.array(list(found))})

    centroids = hold(sample.groupBy().applyInArrow(centres, "part int, centre array<double>"))
    middle = np.array([r.centre for r in centroids.orderBy("part").collect()])  # `partitions` rows
    cuts = _cuts(middle.shape[1], min(code_bytes, middle.shape[1]))

    def residual_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = points(batch.column(0))
            rest = matrix - middle[_nearest_centre(matrix, middle)]
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                yield pa.RecordBatch.from_pydict(
                    {"book": pa.array([i] * len(rest), pa.int32()), "x": pa.array(list(rest[:, a:b]), pa.list_(pa.float64()))}
                )

    def book(table: pa.Table) -> pa.Table:
        found = _means(_matrix(table["x"]), 256)
        n = len(found)
        return pa.table(
            {
                "book": pa.array([table["book"][0].as_py()] * n, pa.int32()),
                "entry": pa.array(range(n), pa.int32()),
                "x": pa.array(list(found), pa.list_(pa.float64())),
            }
        )

    cut = sample.mapInArrow(residual_parts, "book int, x array<double>")
    books = cut.groupBy("book").applyInArrow(book, "book int, entry int, x array<double>")
    centroids.withColumn("metric", F.lit(metric)).coalesce(1).write.parquet(f"{folder}/centroids")
    books.coalesce(1).write.parquet(f"{folder}/books")
    return Index(spark, folder)


# === the index =================================================================================


class Index:
    """A trained index in a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        centres = spark.read.parquet(f"{folder}/centroids").orderBy("part").collect()
        books = spark.read.parquet(f"{folder}/books").orderBy("book", "entry").collect()  # 256 rows a part
        by_book: dict[int, list] = {}
        for r in books:
            by_book.setdefault(r.book, []).append(r.x)
        parts = [np.array(by_book[i]) for i in range(len(by_book))]
        self.model = Model(centres[0].metric, np.array([r.centre for r in centres]), parts)

    def add(self, rows: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> None:
        """Appends rows, each to its partition. Rows without a vector are left out."""
        model, given = self.model, _vectors(rows, id_col, vector_col, "id")
        added = "part int, code binary, error double, off double"
        schema = T.StructType([*given.schema.fields, *T.StructType.fromDDL(added).fields])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    part, codes, error, off = model.encode(model.placed(batch.column(1)))
                    code = pa.array([row.tobytes() for row in codes], pa.binary())
                    values = [pa.array(part, pa.int32()), code, pa.array(error), pa.array(off)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *values], [f.name for f in schema.fields])

        # Partitions of files by place; a hot one is dealt to several tasks.
        found = hold(given.mapInArrow(encode, schema).hint("rebalance", "part"))
        # Codes last: a vector without a code is never looked for.
        for name, columns in (("vectors", ["part", "id", "embedding"]), ("codes", ["part", "id", "code", "error", "off"])):
            found.select(columns).sortWithinPartitions("part", "id").write.mode("append").partitionBy("part").parquet(
                f"{self.folder}/{name}"
            )

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def balls(self) -> DataFrame:
        """part, n_rows, radius: how many rows a partition has, and the farthest one from its centre."""
        return self._table("codes").groupBy("part").agg(F.count("*").alias("n_rows"), F.max("off").alias("radius"))

    def search(
        self,
        queries: DataFrame,
        k: int = fixed.DEFAULT_RESULTS,
        probes: int = 8,
        exact: bool = True,
        query_id_col: str = "query_id",
        query_vector_col: str = "embedding",
        scan_bytes: int = ASK_BYTES,
    ) -> DataFrame:
        """`(query_id, id, distance, rank)` of the `k` nearest rows, ties by id.

        The `probes` nearest partitions give a first limit. `exact` goes on to all partitions that are not
        provably farther, so no neighbour is missed; otherwise those of other partitions are. Queries
        beyond `scan_bytes` are asked in slices.
        """
        found = None
        for asked, limits in self._asked(queries, k, probes, exact, query_id_col, query_vector_col, scan_bytes):
            hits = self._measured(*limits, k).join(small(asked.select("q", "query_id")), "q").drop("q")
            found = hits if found is None else found.unionByName(hits)
        return _ranked(found.select("query_id", "id", "distance"), k)

    def candidates(
        self,
        queries: DataFrame,
        k: int = fixed.DEFAULT_RESULTS,
        probes: int = 8,
        exact: bool = True,
        query_id_col: str = "query_id",
        query_vector_col: str = "embedding",
        scan_bytes: int = ASK_BYTES,
    ) -> list[tuple[DataFrame, DataFrame]]:
        """Per slice of queries `(q, query_id, embedding)` and `(q, part, id)`: whose vectors have to be read."""
        sliced = self._asked(queries, k, probes, exact, query_id_col, query_vector_col, scan_bytes)
        return [(asked, self._scan(*limits, k)) for asked, limits in sliced]

    def _asked(self, queries, k, probes, exact, query_id_col, query_vector_col, scan_bytes) -> Iterator[tuple]:
        """Per slice of queries `(q, query_id, embedding)`: what goes to the tasks, partitions, limits."""
        check_k(k)
        asked = _vectors(queries, query_id_col, query_vector_col, "query_id")
        asked = hold(asked.withColumn("q", F.monotonically_increasing_id()))
        n = asked.count()
        slices = max(1, -(-n * self.model.centroids.shape[1] * 8 // scan_bytes))
        for i in range(slices):
            part = asked.where(F.pmod(F.xxhash64("q"), F.lit(slices)) == i)
            yield part, self._limits(part, k, probes, exact)

    def _limits(self, asked: DataFrame, k: int, probes: int, exact: bool) -> tuple:
        model, table = self.model, asked.select("q", "embedding").toArrow()  # up to `scan_bytes`
        numbers = table["q"].combine_chunks().to_numpy(zero_copy_only=False)
        vectors = model.placed(table["embedding"].combine_chunks())
        balls = self.balls().collect()  # one row per partition
        radius = np.full(len(model.centroids), -np.inf)
        for ball in balls:
            radius[ball["part"]] = ball["radius"]
        size = (vectors * vectors).sum(1)
        away = size[:, None] + (model.centroids**2).sum(1) - 2 * vectors @ model.centroids.T
        away = np.sqrt(np.maximum(away, 0)) if len(vectors) else np.zeros((0, len(radius)))
        away[:, np.isneginf(radius)] = np.inf
        order = np.argsort(away, axis=1, kind="stable")
        near = np.zeros(away.shape, dtype=bool)
        np.put_along_axis(near, order[:, :probes], True, axis=1)
        near &= np.isfinite(away)
        sent = self.spark.sparkContext.broadcast((numbers, vectors))
        limits = self._scan(sent, near, None, k)
        top = Window.partitionBy("q").orderBy("upper")
        kth = (
            limits.withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k).select("q", "upper").toArrow()
        )  # one row per query of the slice
        limit = np.full(len(numbers), np.inf)
        at = {q: i for i, q in enumerate(numbers.tolist())}
        for q, upper in zip(kth["q"].to_pylist(), kth["upper"].to_pylist(), strict=True):
            limit[at[q]] = upper
        if exact:
            lower = np.maximum(away - radius, 0) * (1 - 1e-9)
            near = np.isfinite(away) & (self.model.measure(lower) <= self.model.measure(limit)[:, None] + SLACK)
        return sent, near, limit

    def _scan(self, sent, near: np.ndarray, limit: np.ndarray | None, k: int) -> DataFrame:
        """One pass over the codes of the partitions that `near` (queries x partitions) names.

        Without a limit the `k` least upper bounds of every query and task; with one the rows within it.
        """
        model, measure = self.model, self.model.measure
        parts = np.flatnonzero(near.any(axis=0)).tolist()
        codes = self._table("codes").where(F.col("part").isin(parts)).select("part", "id", "code", "error")
        id_type = codes.schema["id"].dataType

        bounds = self._bounds(sent, near)

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = sent.value[0]
            best = np.full((len(numbers), k), np.inf)
            for whole in batches:
                for at in range(0, len(whole), BLOCK_ROWS):
                    for ask, _, d, error in bounds(whole.slice(at, BLOCK_ROWS)):
                        upper = np.concatenate([best[ask], (d + error) * (1 + 1e-9)], axis=1)
                        best[ask] = np.partition(upper, k - 1, axis=1)[:, :k]
            q, _ = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_pydict({"q": pa.array(numbers[q]), "upper": pa.array(best[np.isfinite(best)])})

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = sent.value[0]
            for whole in batches:
                for at in range(0, len(whole), BLOCK_ROWS):
                    batch = whole.slice(at, BLOCK_ROWS)
                    for ask, rows, d, error in bounds(batch):
                        lower = measure(np.maximum(d - error, 0) * (1 - 1e-9))
                        i, j = np.nonzero(lower <= measure(limit[ask])[:, None] + SLACK)
                        taken = pa.array(rows[j])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(numbers[ask[i]]), batch.column(0).take(taken), batch.column(1).take(taken)],
                            ["q", "part", "id"],
                        )

        if limit is None:
            return codes.mapInArrow(least, "q long, upper double")
        fields = [T.StructField("q", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("id", id_type)]
        return codes.mapInArrow(within, T.StructType(fields))

    def _bounds(self, sent, near: np.ndarray):
        """Of a batch `part, id, code, error`: per partition the queries, the rows, and the distances and
        errors of what the codes say."""
        model = self.model

        def bounds(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            vectors = sent.value[1]
            part = batch.column(0).to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(part), -1)
            error = batch.column(3).to_numpy(zero_copy_only=False)
            for p in np.unique(part):
                rows, asks = np.flatnonzero(part == p), np.flatnonzero(near[:, p])
                x = model.rebuilt(part[rows], code[rows])
                for start in range(0, len(asks), ASK_ROWS):
                    ask = asks[start : start + ASK_ROWS]
                    v = vectors[ask]
                    square = (v * v).sum(1)[:, None] + (x * x).sum(1) - 2 * v @ x.T
                    yield ask, rows, np.sqrt(np.maximum(square, 0)), error[rows]

        return bounds

    def _measured(self, sent, near: np.ndarray, limit: np.ndarray, k: int) -> DataFrame:
        """`(q, id, distance)`: the `k` nearest rows of every query and task, by exact distances.

        Codes meet their vectors by a join as long as the table; pairs of queries and rows are gone through
        in the tasks and never become rows.
        """
        model, measure, bounds = self.model, self.model.measure, self._bounds(sent, near)
        parts = np.flatnonzero(near.any(axis=0)).tolist()
        codes = self._table("codes").where(F.col("part").isin(parts))
        vectors = self._table("vectors").where(F.col("part").isin(parts))
        rows = codes.join(vectors, ["part", "id"]).select("part", "id", "code", "error", "embedding")

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, asked = sent.value
            best = _Nearest(pa.array(numbers), asked, k, "l2sq")
            for whole in batches:
                for at in range(0, len(whole), BLOCK_ROWS):
                    batch = whole.slice(at, BLOCK_ROWS)
                    placed, ids = model.placed(batch.column(4)), batch.column(1)
                    for ask, rows, d, error in bounds(batch):
                        lower = measure(np.maximum(d - error, 0) * (1 - 1e-9))
                        within = np.minimum(measure(limit[ask]), best.bound[ask]) + SLACK
                        i, j = np.nonzero(lower <= within[:, None])
                        for start in range(0, len(i), PAIRS):
                            some = slice(start, start + PAIRS)
                            q, x = ask[i[some]], rows[j[some]]
                            if model.metric == "cosine":
                                exact = 1 - np.einsum("ij,ij->i", asked[q], placed[x])
                            else:
                                exact = ((asked[q] - placed[x]) ** 2).sum(1)
                            exact = np.round(exact, DIGITS) + 0.0
                            kept = np.flatnonzero(exact <= best.bound[q])
                            found = pa.table(
                                {
                                    "q": pa.array(q[kept], pa.int64()),
                                    "distance": pa.array(exact[kept]),
                                    "id": ids.take(pa.array(x[kept])),
                                }
                            )
                            best.best = best._cut(found if best.best is None else pa.concat_tables([best.best, found]))
            result = best.result()
            if result is not None:
                yield from result.rename_columns(["q", "id", "distance"]).to_batches()

        fields = [
            T.StructField("q", T.LongType()),
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
        return rows.mapInArrow(nearest, T.StructType(fields))
