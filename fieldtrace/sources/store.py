"""The stored tables: code records, mapping records and tombstones, as append-only Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrace import fixed
from fieldtrace.functions import text as tx
from fieldtrace.operators import dedup
from fieldtrace.operators.embedding import embedded_only
from fieldtrace.plans import entries as en
from fieldtrace.session import hold

CODE = "code_files"
MAPPINGS = "code_mappings"
TOMBSTONES = "tombstones"

SCHEMAS = {
    CODE: "id string, file_path string, file_name string, file_type string, chunk_index int, "
    "total_chunks int, document string, embedding array<float>, batch_id bigint",
    MAPPINGS: "id string, file_path string, mapping_type string, source_type string, "
    "target_type string, interface string, method string, document string, "
    "embedding array<float>, extra map<string,string>, batch_id bigint",
    TOMBSTONES: "table_name string, id string, file_path string, batch_id bigint",
}


class Store:
    """Tables under one folder. Rows are only ever added; deletes are rows of their own.

    A row is live when no tombstone of its id or its file has the row's batch or a later one, so a
    row put in again after a delete is live again. A write that is run twice adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for table in SCHEMAS:
            # A folder without files reads as an empty table, as the schema is given.
            where = spark._jvm.org.apache.hadoop.fs.Path(self._at(table))
            where.getFileSystem(conf).mkdirs(where)

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _empty(self, table: str) -> None:
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        empty.coalesce(1).write.mode("overwrite").parquet(self._at(table))

    def read(self, table: str) -> DataFrame:
        """All rows of a table, deleted ones too."""
        return self.spark.read.schema(SCHEMAS[table]).parquet(self._at(table))

    def live(self, table: str) -> DataFrame:
        """The rows that are not deleted."""
        return live_rows(self.read(table), self.read(TOMBSTONES).where(F.col("table_name") == table))

    def code(self) -> DataFrame:
        return self.live(CODE)

    def mappings(self) -> DataFrame:
        return self.live(MAPPINGS)

    def next_batch(self) -> int:
        """A batch number above all in use."""
        used = [self.read(t).agg(F.max("batch_id").alias("b")) for t in SCHEMAS]
        return (dedup.union_all(used).agg(F.max("b")).first()[0] or 0) + 1

    def append(self, table: str, rows: DataFrame, batch_id: int) -> None:
        names = [f.name for f in self.read(table).schema.fields]
        for name in names:
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None))
        types = {f.name: f.dataType for f in self.read(table).schema.fields}
        rows = rows.withColumn("batch_id", F.lit(batch_id))
        # A file's code stands in each of its mappings; this codec finds it again at such a distance.
        rows.select(*[F.col(n).cast(types[n]).alias(n) for n in names]).write.mode("append").option(
            "compression", "zstd"
        ).parquet(self._at(table))

    def add_code(
        self,
        records: DataFrame,
        embed: Callable[[DataFrame, str], DataFrame],
        mode: str = "skip",
        batch_id: int | None = None,
    ) -> int:
        """Code records that are not stored yet, with their vectors; those without one are dropped.

        Stored ids are dropped ahead of embedding. `mode="replace"` takes all records and then deletes
        older rows of their files: a run that breaks off leaves files doubled, to be replaced again, and
        never missing. Returns the batch number.
        """
        batch_id = self.next_batch() if batch_id is None else batch_id
        if mode == "replace":
            records = records.dropDuplicates(["id"])
            self.append(CODE, embedded_only(embed(records, "document")), batch_id)
            self.delete_files(CODE, records.select("file_path").distinct(), batch_id - 1)
        elif mode == "skip":
            new = dedup.insert_if_absent(records, self.live(CODE))
            self.append(CODE, embedded_only(embed(new, "document")), batch_id)
        else:
            raise ValueError("mode must be skip or replace")
        return batch_id

    def add_mappings(
        self,
        records: DataFrame,
        embed: Callable[[DataFrame, str], DataFrame],
        batch_id: int | None = None,
        sources: DataFrame | None = None,
    ) -> int:
        """Mapping records that are not stored yet, with their vectors.

        `sources` gives the code that goes behind the text of records made without it. It is put there on
        the way to the table: a file's code, once for each of its mappings, is neither held nor shuffled.
        """
        batch_id = self.next_batch() if batch_id is None else batch_id
        # Both the look-up and the write read them, and they are costly to extract.
        records = hold(records)
        new = dedup.insert_if_absent(records, self.live(MAPPINGS))
        if sources is not None:
            new = with_code(new, sources)
        self.append(MAPPINGS, embedded_only(embed(new, "document")), batch_id)
        return batch_id

    def delete_ids(self, table: str, ids: DataFrame, batch_id: int | None = None) -> None:
        """Deletes by id; `ids` has the column `id`."""
        batch_id = self.next_batch() - 1 if batch_id is None else batch_id
        self.append(TOMBSTONES, ids.select(F.lit(table).alias("table_name"), "id"), batch_id)

    def delete_files(self, table: str, paths: DataFrame, batch_id: int | None = None) -> None:
        """Deletes all rows of files; `paths` has the column `file_path`."""
        batch_id = self.next_batch() - 1 if batch_id is None else batch_id
        rows = paths.select(F.lit(table).alias("table_name"), "file_path")
        self.append(TOMBSTONES, rows, batch_id)

    def reset(self, code: bool = True) -> None:
        """Empties the mapping table, and the code table unless told not to."""
        self._empty(MAPPINGS)
        names = [MAPPINGS] + ([CODE] if code else [])
        if code:
            self._empty(CODE)
            self._empty(TOMBSTONES)
        else:
            kept = self.read(TOMBSTONES).where(~F.col("table_name").isin(names))
            # Written aside first: a folder cannot be overwritten while it is read.
            aside = f"{self.path}/{TOMBSTONES}.keep"
            kept.write.mode("overwrite").parquet(aside)
            self.spark.read.schema(SCHEMAS[TOMBSTONES]).parquet(aside).write.mode(
                "overwrite"
            ).parquet(self._at(TOMBSTONES))


def live_rows(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows without a tombstone of their batch or a later one, by id or by file."""
    out = rows
    for key in ("id", "file_path"):
        dead = (
            tombstones.where(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("__key"))
            .agg(F.max("batch_id").alias("__until"))
        )
        gone = (F.col(key) == F.col("__key")) & (F.col("batch_id") <= F.col("__until"))
        out = out.join(dead, gone, "left_anti")
    return out


def listing(rows: DataFrame, limit: int | None = None, key: str = "id") -> DataFrame:
    """All rows, or the first `limit` by id."""
    return rows if limit is None else rows.orderBy(key).limit(limit)


def mapping_records(
    entry_rows: DataFrame,
    sources: DataFrame | None = None,
    extra: Column | None = None,
    code_chars: int | None = None,
) -> DataFrame:
    """Entries as records of the mapping table, with id, text and metadata.

    `sources` gives the code that goes into the text, all of it or its first `code_chars` characters
    (a file's code stands in each of its mappings). `extra` is a map of caller metadata;
    its values win over the default of the same name.
    """
    rows = en.with_id(entry_rows)
    if sources is not None:
        # Only the part that is shown goes through the join.
        start = F.col("content") if code_chars is None else F.substring("content", 1, code_chars)
        code = sources.select("file_path", start.alias("__code"))
        rows = rows.join(code, "file_path", "left")
    text = en.document(F.col("__code") if sources is not None else None)
    defaults = {
        "file_path": F.col("file_path"),
        "mapping_type": tx.default_text("type", "unknown"),
        "source_type": tx.default_text("source_type", ""),
        "target_type": tx.default_text("target_type", ""),
        "interface": tx.default_text("interface", ""),
        "method": tx.default_text("method", ""),
    }
    extra = extra if extra is not None else F.lit(None).cast("map<string,string>")
    return rows.select(
        "id",
        *[F.coalesce(extra[n], c).alias(n) for n, c in defaults.items()],
        text.alias("document"),
        F.map_filter(extra, lambda k, _: ~k.isin(list(defaults))).alias("extra"),
        "pos",
        *(["embedding"] if "embedding" in entry_rows.columns else []),
    )


def with_code(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records made without code, with all the code of their file behind the text as `mapping_records` puts it."""
    code = sources.select("file_path", en.snippet(F.col("content")).alias("__code"))
    text = F.concat_ws("\n", "document", "__code")
    return records.join(code, "file_path", "left").withColumn("document", text).select(*records.columns)


def batch_records(
    entry_rows: DataFrame, sources: DataFrame | None = None, extra: Column | None = None
) -> DataFrame:
    """Mapping records of one batch with repeated ids told apart."""
    return dedup.unique_ids(mapping_records(entry_rows, sources, extra))
