"""What the operators share: table access, blocks of texts in Python tasks, files in the work folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fieldtrace.session import filesystem, passing_path

# The white space of the contracts; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

# Texts that a Python task works on at once; a longer text is a block of its own. Arrays over the bytes of
# a block take up to a hundred times its size, and a worker keeps what it once took.
BLOCK_BYTES = 1 << 18

Block = tuple[pa.Table, list[bytes]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty. Each word becomes one letter first."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(marks, SPACE, "")).cast("long")


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Slices of the batches with at most `limit` bytes of text (or one row), and their texts.

    Null texts become empty ones. Memory follows the limit and the longest text, not the batch.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
        start, filled = 0, 0
        for at, size in enumerate(sizes):
            if at > start and filled + size > limit:
                yield _block(batch, column, start, at)
                start, filled = at, 0
            filled += int(size)
        if start < len(sizes):
            yield _block(batch, column, start, len(sizes))


def _block(batch: pa.RecordBatch, column: pa.Array, start: int, end: int) -> Block:
    rows = pa.Table.from_batches([batch.slice(start, end - start)])
    texts = column.slice(start, end - start).cast(pa.binary()).to_pylist()
    return rows, [text or b"" for text in texts]


def add_columns(
    docs: DataFrame,
    text_col: str,
    make: Callable[..., dict[str, pa.Array]],
    added: str,
    limit: int = BLOCK_BYTES,
    given: Column | None = None,
) -> DataFrame:
    """`docs` with the columns `added` (as DDL), which `make` works out from a list of texts.

    `given` is a further value per row that `make` takes beside the texts. Columns of `docs` with a name
    among the added ones give way. All columns travel as one struct, so that their names do no harm.
    """
    fields = T.StructType.fromDDL(added).fields
    others = without(docs, *[f.name for f in fields])
    # Texts go to Python once: in the struct, or beside it if their column gives way.
    inside = [i for i, c in enumerate(others) if c.lower() == text_col.lower()]
    beside = F.lit(None).cast("string") if inside else F.col(f"`{text_col}`")
    packed = docs.select(
        packed_columns(others),
        beside.alias("text"),
        (F.lit(None).cast("int") if given is None else given).alias("given"),
    )
    schema, more = T.StructType([packed.schema["rest"], *fields]), given is not None

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.column(0)
            text = rest.field(1 + inside[0]) if inside else batch.column(1)
            yield pa.RecordBatch.from_arrays([rest, text, batch.column(2)], ["rest", "text", "given"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(named(batches), "text", limit):
            found = make(texts, rows["given"]) if more else make(texts)
            yield from pa.table({"rest": rows["rest"], **found}).to_batches()

    found = packed.mapInArrow(run, schema)
    return found.select(*unpacked(others), *[f"`{f.name}`" for f in fields])


def packed_columns(names: list[str]) -> Column:
    """Columns as one struct, with names of its own."""
    return F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("rest")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col(f"rest.c{i}").alias(c) for i, c in enumerate(names)]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most so many rows to Python at once in this session: texts are long, and a batch is held
    on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def without(docs: DataFrame, *names: str) -> list[str]:
    """The columns of `docs` but those; as in Spark, case makes no difference."""
    gone = {name.lower() for name in names}
    return [c for c in docs.columns if c.lower() not in gone]


def ragged(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `values[begin:begin + size]` one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begins - (ends - sizes), sizes)], ends


# === files that tasks write and read ===========================================================


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared work folder, kept until the session's JVM ends."""
    path = passing_path(spark, name)
    system, inner = filesystem(path)
    system.create_dir(inner, recursive=True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared work folder, read back: computed once, lineage cut."""
    path = passing_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_files(df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """As `written`, with the table's files, for tasks that read them by themselves."""
    path = passing_path(df.sparkSession, name)
    df.write.parquet(path)
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).listStatus(where)
    files = sorted(f.getPath().toString() for f in found if f.getPath().getName().endswith(".parquet"))
    return df.sparkSession.read.schema(df.schema).parquet(path), files
