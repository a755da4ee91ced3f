"""Nearest neighbours: exact scan, exact grid join, and hashed cells, exact or not, for large tables.

All forms return `(query_id, id, distance, rank)`, nearest first, ties by id. Distances are rounded
to six digits before ranking: vectors are floats, and copies of one vector must tie on every
machine.

No form builds the pairs. Tasks multiply blocks of vectors and pass on `k` rows per query; only
those are shuffled to the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldtrace import fixed
from fieldtrace.operators.embedding import embedded_only
from fieldtrace.session import filesystem, hold, passing_path

METRICS = ("cosine", "l2sq")
DIGITS = 6
SCAN_QUERY_BYTES = 64 << 20
BLOCK_CELLS = 1 << 22
SLICE_ROWS = 16384
BLOCK_ROWS = 4096
MERGE_TASKS = 64
MAX_BITS = 16  # cells are counted in a table that goes to all tasks
DEFAULT_BITS = 4
FAR_CELLS = 256  # a query that needs more cells meets the whole table instead


def check_k(k: int) -> int:
    if k < fixed.MIN_RESULTS:
        raise ValueError(f"k must be at least {fixed.MIN_RESULTS}")
    return k


def match_all(df: DataFrame, where: dict | None) -> DataFrame:
    """Rows that equal every given column value; applied ahead of any distance."""
    for name, value in (where or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def similarity(distance="distance") -> Column:
    return F.lit(1.0) - (F.col(distance) if isinstance(distance, str) else distance)


# --- blocks of vectors -------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = set(pc.list_value_length(column).to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(map(str, lengths))[:5]}")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        d = 1.0 - queries @ rows.T
    else:
        d = (queries * queries).sum(1)[:, None] + (rows * rows).sum(1)[None, :]
        d = np.maximum(d - 2.0 * (queries @ rows.T), 0.0)
    return np.round(d, DIGITS) + 0.0


class _Nearest:
    """The `k` nearest rows of every query seen so far."""

    def __init__(self, query_ids: pa.Array, queries: np.ndarray, k: int, metric: str):
        self.metric, self.k, self.query_ids = metric, k, query_ids
        self.queries = _unit(queries) if metric == "cosine" else queries
        self.bound = np.full(len(queries), np.inf)
        self.best: pa.Table | None = None

    def add(self, ids: pa.Array, rows: np.ndarray) -> None:
        rows = _unit(rows) if self.metric == "cosine" else rows
        step = max(1, BLOCK_CELLS // max(1, len(rows)))
        found = [self.best] if self.best is not None else []
        for start in range(0, len(self.queries), step):
            d = _distances(self.queries[start : start + step], rows, self.metric)
            bound = self.bound[start : start + step]
            if d.shape[1] > self.k:
                bound = np.minimum(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            # `<=` keeps ties with the k-th distance: the id decides among them.
            at_query, at_row = np.nonzero(d <= bound[:, None])
            found.append(
                pa.table(
                    {
                        "q": pa.array(at_query + start, pa.int64()),
                        "distance": pa.array(d[at_query, at_row]),
                        "id": ids.take(pa.array(at_row)),
                    }
                )
            )
        self.best = self._cut(pa.concat_tables(found))

    def _cut(self, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(
            table, [("q", "ascending"), ("distance", "ascending"), ("id", "ascending")]
        )
        table = table.take(order).combine_chunks()
        q = table["q"].to_numpy()
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        full = place == self.k - 1
        self.bound[q[full]] = table["distance"].to_numpy()[full]
        return table.filter(pa.array(place < self.k))

    def result(self) -> pa.Table | None:
        if self.best is None or not len(self.best):
            return None
        return pa.table(
            {
                "query_id": self.query_ids.take(self.best["q"].combine_chunks()),
                "id": self.best["id"],
                "distance": self.best["distance"],
            }
        )


def _hit_schema(queries: DataFrame, rows: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The final `k` of each query, in two steps: those of some tasks together, then of all.

    So the last step takes `k` rows for every MERGE_TASKS tasks and not for every task.
    """

    def cut(rows: DataFrame, *keys: str) -> DataFrame:
        nearest = Window.partitionBy(*keys).orderBy("distance", "id")
        return rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    tasks = (F.spark_partition_id() / MERGE_TASKS).cast("int")
    first = cut(hits.withColumn("__tasks", tasks), "query_id", "__tasks")
    return cut(first.drop("__tasks", "rank"), "query_id")


def _vectors(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    return embedded_only(df, vector_col).select(
        F.col(id_col).alias(name), F.col(vector_col).alias("embedding")
    )


# --- exact -------------------------------------------------------------------------------------


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = fixed.DEFAULT_RESULTS,
    where: dict | None = None,
    metric: str = "cosine",
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vector_col: str = "embedding",
    scan_bytes: int = SCAN_QUERY_BYTES,
) -> DataFrame:
    """Exact `k` nearest rows of every query.

    Queries are counted first. Up to `scan_bytes` they are sent to all tasks and the table is read
    once, in place; more go through `grid_join`.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    check_k(k)
    table = _vectors(match_all(rows, where), id_col, vector_col, "id")
    # Held, as they are counted before they are sent: a model behind them is asked once.
    asked = hold(_vectors(queries, query_id_col, query_vector_col, "query_id"))
    n, dim = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if n and n * dim * 8 > scan_bytes:
        return grid_join(table, asked, k, metric)
    return _scan(table, asked, k, metric, dim or 0)


def _scan(table: DataFrame, asked: DataFrame, k: int, metric: str, dim: int) -> DataFrame:
    local = asked.toArrow()
    sent = table.sparkSession.sparkContext.broadcast(
        (local["query_id"].combine_chunks(), _matrix(local["embedding"]))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(*sent.value, k, metric)
        for batch in batches:
            if len(batch) and len(best.queries):
                rows = _matrix(batch.column(1))
                if rows.shape[1] != dim:
                    raise ValueError(f"vectors of length {rows.shape[1]}, queries of length {dim}")
                best.add(batch.column(0), rows)
        result = best.result()
        if result is not None:
            yield from result.to_batches()

    return _ranked(table.mapInArrow(scan, _hit_schema(asked, table)), k)


def grid_join(
    table: DataFrame,
    asked: DataFrame,
    k: int,
    metric: str = "cosine",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Exact neighbours for query tables of any size: slices of queries meet the rows, block by block.

    A task holds one slice of queries and one block of rows, whatever the sizes of the tables.
    """
    rows = _by_cell(table.withColumn("cell", F.lit(0)))
    return _cells_join(rows, asked.withColumn("cell", F.lit(0)), k, metric, slice_rows)


class _Cells(NamedTuple):
    """Rows in files, a folder for each cell."""

    path: str
    schema: T.StructType


def _by_cell(table: DataFrame) -> _Cells:
    """`(cell, id, embedding)` written by cell; a file holds about SLICE_ROWS rows, or the whole cell."""
    sizes = table.groupBy("cell").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("n"))
    path = passing_path(table.sparkSession, "cells")
    (
        table.join(F.broadcast(sizes), "cell")
        .repartition("cell", F.pmod(F.xxhash64("id"), F.col("n")))
        .select("cell", "id", "embedding")
        .write.partitionBy("cell").parquet(path)
    )
    return _Cells(path, table.select("id", "embedding").schema)


def _blocks(path: str, cells: list[int], id_type: pa.DataType) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of cells, in blocks."""
    system, inner = filesystem(path)
    for cell in cells:
        found = system.get_file_info(pafs.FileSelector(f"{inner}/cell={cell}", allow_not_found=True))
        for file in sorted(f.path for f in found if f.base_name.endswith(".parquet")):
            with system.open_input_file(file) as source:
                for block in pq.ParquetFile(source).iter_batches(BLOCK_ROWS, columns=["id", "embedding"]):
                    yield block.column("id").cast(id_type), _matrix(block.column("embedding"))


def _cells_join(
    rows: _Cells, asked: DataFrame, k: int, metric: str, slice_rows: int, flips: tuple[int, ...] = (0,)
) -> DataFrame:
    """Neighbours of queries among the rows of their cell, and of the cells that differ from it by `flips`.

    A cell's queries are cut into slices. A task reads the files of the cells its slice meets, so neither rows
    nor hits of pairs of slices are shuffled: disk and shuffle grow with the tables and not with their product.
    """
    n_asked = asked.groupBy("cell").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("n_qs"))
    n_asked = hold(n_asked)
    n_slices = n_asked.agg(F.sum("n_qs")).first()[0] or 0
    spark = asked.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sliced = (
        asked.join(F.broadcast(n_asked), "cell")
        .withColumn("qs", F.pmod(F.xxhash64("query_id"), F.col("n_qs")).cast("int"))
        .select("cell", "qs", "query_id", "embedding")
        # A slice is little to shuffle and much to do, so its number of tasks is not left to sizes.
        .repartition(max(1, min(n_slices, most)), "cell", "qs")
    )
    path = rows.path
    schema = T.StructType(
        [asked.select("query_id").schema[0], rows.schema["id"], T.StructField("distance", T.DoubleType())]
    )
    arrow = to_arrow_schema(schema)

    def meet(key: tuple, queries: pa.Table) -> pa.Table:
        best = _Nearest(queries["query_id"].combine_chunks(), _matrix(queries["embedding"]), k, metric)
        cells = [key[0].as_py() ^ flip for flip in flips]
        for ids, block in _blocks(path, cells, arrow.field("id").type):
            if block.shape[1] != best.queries.shape[1]:
                raise ValueError(f"vectors of length {block.shape[1]}, queries of length {best.queries.shape[1]}")
            best.add(ids, block)
        found = best.result()
        return arrow.empty_table() if found is None else found

    return _ranked(sliced.groupBy("cell", "qs").applyInArrow(meet, schema), k)


# --- approximate -------------------------------------------------------------------------------


def _sign_rows(bits: int, dim: int) -> np.ndarray:
    """Hyperplanes with entries +1 and -1: sign (-1)^bitcount(plane & dimension)."""
    plane = np.arange(1, bits + 1)[:, None] & np.arange(dim)[None, :]
    parity = np.zeros_like(plane)
    while plane.any():
        parity ^= plane & 1
        plane >>= 1
    return 1.0 - 2.0 * parity


def with_cell(df: DataFrame, bits: int, vector_col: str = "embedding") -> DataFrame:
    """Adds `cell`: one bit per hyperplane, set where the vector lies on its positive side."""

    @F.arrow_udf(T.IntegerType())
    def cell(vectors: pa.Array) -> pa.Array:
        matrix = _matrix(vectors)
        side = np.round(matrix @ _sign_rows(bits, matrix.shape[1]).T, DIGITS) > 0
        return pa.array((side @ (1 << np.arange(bits))).astype(np.int32))

    return df.withColumn("cell", cell(vector_col) if bits else F.lit(0))


def nearest_approx(
    rows: DataFrame,
    queries: DataFrame,
    k: int = fixed.DEFAULT_RESULTS,
    where: dict | None = None,
    metric: str = "cosine",
    bits: int = DEFAULT_BITS,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vector_col: str = "embedding",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Nearest rows among those in the query's hash cell and the cells one bit away.

    Exact distances inside the cells; the queries of a cell that holds much of the table are cut into
    slices, so it costs more tasks and not a larger one. Rows in farther cells are not seen, which is the
    approximation: see `recall`. `bits` alone says how fine the cells are, whatever the table holds.
    Where no neighbour may be lost, use `nearest_cells`.
    """
    check_k(k)
    table = _vectors(match_all(rows, where), id_col, vector_col, "id")
    asked = hold(_vectors(queries, query_id_col, query_vector_col, "query_id"))
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be between 0 and {MAX_BITS}")
    flips = (0, *[1 << b for b in range(bits)])
    return _cells_join(_by_cell(with_cell(table, bits)), with_cell(asked, bits), k, metric, slice_rows, flips)


def _unit_planes(bits: int, dim: int) -> np.ndarray:
    return _sign_rows(bits, dim) / np.sqrt(dim)


def _cell_numbers(matrix: np.ndarray, bits: int) -> np.ndarray:
    side = matrix @ _unit_planes(bits, matrix.shape[1]).T > 0
    return (side @ (1 << np.arange(bits))).astype(np.int32)


def _row_cells(bits: int, metric: str):
    """The cell of a row. With cosine, zero vectors are as far from all queries: a cell of their own."""

    @F.arrow_udf(T.IntegerType())
    def cell(vectors: pa.Array) -> pa.Array:
        matrix = _matrix(vectors)
        if metric == "l2sq":
            return pa.array(_cell_numbers(matrix, bits))
        unit = _unit(matrix)
        return pa.array(np.where(unit.any(axis=1), _cell_numbers(unit, bits), 1 << bits).astype(np.int32))

    return cell


def _first_cells(bits: int, metric: str):
    """The cell of a query and those one bit away."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cells(vectors: pa.Array) -> pa.Array:
        matrix = _matrix(vectors)
        own = _cell_numbers(_unit(matrix) if metric == "cosine" else matrix, bits)
        flips = np.array([0] + [1 << b for b in range(bits)], dtype=np.int32)
        return pa.array(list(own[:, None] ^ flips), pa.list_(pa.int32()))

    return cells


def _far_cells(bits: int, metric: str, held: np.ndarray, most: int):
    """The other cells that may hold a row as near as `kth`; null if they are more than `most`.

    A row on the other side of a plane is at least as far as the plane. Over several planes the squares
    add up, divided by the largest eigenvalue of the planes' products (1 if they are orthogonal).
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cells(vectors: pa.Array, kth: pa.Array) -> pa.Array:
        matrix = _matrix(vectors)
        if metric == "cosine":
            matrix = _unit(matrix)
        planes = _unit_planes(bits, matrix.shape[1])
        wide = max([1.0, *np.linalg.eigvalsh(planes @ planes.T)])
        apart = (matrix @ planes.T) ** 2 / wide
        own, size = _cell_numbers(matrix, bits), (matrix * matrix).sum(1)
        limit = pc.fill_null(kth, np.inf).to_numpy(zero_copy_only=False)
        found: list[np.ndarray | None] = []
        step = max(1, BLOCK_CELLS // max(1, len(held)))
        for start in range(0, len(matrix), step):
            at = slice(start, start + step)
            other = own[at, None] ^ held[None, :]
            least, n_other = np.zeros(other.shape), np.zeros(other.shape, dtype=np.int8)
            for b in range(bits):
                crossed = (other >> b) & 1
                least += crossed * apart[at, b, None]
                n_other += crossed.astype(np.int8)
            if metric == "cosine":
                least /= 2  # of unit vectors, the cosine distance is half the squared one
                zero = held == 1 << bits
                least[:, zero], n_other[:, zero] = 1.0, 2
            # Distances are rounded, and have the rounding errors of sums.
            surely = least * (1 - 1e-9) - 1e-9 * size[at, None] - 2 * 10.0**-DIGITS
            wanted = ~(surely > limit[at, None]) & (n_other > 1)
            found += [held[row] if row.sum() <= most else None for row in wanted]
        return pa.array(found, pa.list_(pa.int32()))

    return cells


def nearest_cells(
    rows: DataFrame,
    queries: DataFrame,
    k: int = fixed.DEFAULT_RESULTS,
    where: dict | None = None,
    metric: str = "cosine",
    bits: int = DEFAULT_BITS,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vector_col: str = "embedding",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Exact `k` nearest rows, by hash cells.

    The query's cell and those one bit away give a first k-th distance. Then come all cells that are not
    provably farther; a query that needs more cells than the table has slices, or than FAR_CELLS, meets
    the whole table by `nearest`.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    check_k(k)
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be between 0 and {MAX_BITS}")
    table = _vectors(match_all(rows, where), id_col, vector_col, "id")
    asked = hold(_vectors(queries, query_id_col, query_vector_col, "query_id"))
    celled = table.withColumn("cell", _row_cells(bits, metric)("embedding"))
    counts = celled.groupBy("cell").count().collect()  # at most 2^16 + 1 rows
    held = np.array(sorted(r["cell"] for r in counts), dtype=np.int32)
    most = min(FAR_CELLS, -(-sum(r["count"] for r in counts) // slice_rows))

    probes = asked.withColumn("cell", F.explode(_first_cells(bits, metric)("embedding")))
    by_cell = _by_cell(celled)
    first = hold(_cells_join(by_cell, probes, k, metric, slice_rows).drop("rank"))
    kth = first.groupBy(F.col("query_id").alias("__id")).agg(
        F.when(F.count("*") >= k, F.max("distance")).alias("kth")
    )
    # Rows that share a query id are ranked together, so they go the same way.
    whole = F.max(F.col("far").isNull()).over(Window.partitionBy("query_id"))
    placed = hold(
        asked.join(kth, F.col("query_id").eqNullSafe(F.col("__id")), "left")
        .withColumn("far", _far_cells(bits, metric, held, most)("embedding", "kth"))
        .withColumn("whole", whole)
        .select("query_id", "embedding", "far", "whole")
    )
    in_cells = placed.where(~F.col("whole")).select(
        "query_id", "embedding", F.explode("far").alias("cell")
    )
    on_all = placed.where("whole").select("query_id", "embedding")
    again = on_all.select(F.col("query_id").alias("__id")).distinct()
    hits = (
        first.join(again, F.col("query_id").eqNullSafe(F.col("__id")), "left_anti")
        .unionByName(_cells_join(by_cell, in_cells, k, metric, slice_rows).drop("rank"))
        .unionByName(nearest(table, on_all, k, metric=metric).drop("rank"))
    )
    return _ranked(hits, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, over all queries."""
    keys = ["query_id", "id"]
    hit = found.select(*keys).withColumn("hit", F.lit(1))
    return exact.join(hit, keys, "left").agg(
        F.count("*").alias("n_exact"),
        F.count("hit").alias("n_found"),
        F.round(F.count("hit") / F.count("*"), 6).alias("recall"),
    )


# --- retrieval ---------------------------------------------------------------------------------


def dual_nearest(
    mappings: DataFrame, code: DataFrame, questions: DataFrame, k: int = fixed.DEFAULT_RESULTS, **kw
) -> DataFrame:
    """The same questions against the mapping table and the code table."""
    return (
        nearest(mappings, questions, k, **kw)
        .withColumn("kind", F.lit("mapping"))
        .unionByName(nearest(code, questions, k, **kw).withColumn("kind", F.lit("code")))
    )
