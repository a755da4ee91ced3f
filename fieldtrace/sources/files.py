"""Source trees as DataFrames `(project_index, file_path, content, error)`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrace import fixed
from fieldtrace.functions import text as tx

SOURCE_SCHEMA = "project_index int, file_path string, content string, error string"


def _plain_path(c) -> Column:
    return F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/+", "/")


def scan_files(
    spark: SparkSession,
    path: str | list[str],
    recursive: bool = True,
    extensions: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """`(file_path, content binary)` of the files under a folder, or of single files.

    The extension is checked while listing and the globs on the file metadata, so contents of
    dropped files are not read.
    """
    extensions = extensions or fixed.EXTENSIONS
    names = ",".join(sorted(e.lstrip(".") for e in extensions))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.{" + names + "}")
        .load(path)
    )
    if exclude:
        files = files.where(~tx.excluded(_plain_path(F.col("_metadata.file_path")), exclude))
    return files.select(_plain_path(F.col("_metadata.file_path")).alias("file_path"), "content")


def read_text(files: DataFrame, strict: bool = False) -> DataFrame:
    """`content` bytes to text; `strict` keeps bad files as an error row without text."""
    if strict:
        error = tx.strict_utf8_error("content")
        text = F.when(error.isNull(), tx.unix_newlines(F.col("content").cast("string")))
    else:
        error, text = F.lit(None).cast("string"), tx.lenient_utf8("content")
    return files.withColumn("error", error).withColumn("content", text)


def usable_roots(spark: SparkSession, roots: list[str]) -> list[tuple[int, str, bool]]:
    """`(project_index, root, exists)` of all roots; blank ones are left out."""
    out = []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for index, root in enumerate(roots, 1):
        root = root.strip()
        if root:
            where = spark._jvm.org.apache.hadoop.fs.Path(root)
            out.append((index, root, bool(where.getFileSystem(conf).exists(where))))
    return out


def _covers(outer: str, root: str, earlier: bool, recursive: bool) -> bool:
    outer, root = outer.rstrip("/"), root.rstrip("/")
    return (outer == root and earlier) or (recursive and root.startswith(outer + "/"))


def scan_roots(
    spark: SparkSession,
    roots: list[str],
    recursive: bool = True,
    extensions: list[str] | None = None,
    exclude: list[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Texts of all files under the roots, each file once; missing roots give no rows.

    A root inside another one, or given again, adds nothing: its files are the outer one's.
    """
    found = [(index, root) for index, root, exists in usable_roots(spark, roots) if exists]
    parts = [
        read_text(scan_files(spark, root, recursive, extensions, exclude), strict)
        .withColumn("project_index", F.lit(index))
        .select("project_index", "file_path", "content", "error")
        for index, root in found
        if not any(_covers(other, root, at < index, recursive) for at, other in found if at != index)
    ]
    if not parts:
        return spark.createDataFrame([], SOURCE_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def root_report(spark: SparkSession, roots: list[str], sources: DataFrame) -> DataFrame:
    """Per root: does it exist, how many files were read."""
    table = spark.createDataFrame(
        usable_roots(spark, roots), "project_index int, root string, found boolean"
    )
    counts = sources.groupBy("project_index").agg(F.count("*").alias("n_files"))
    return table.join(counts, "project_index", "left").fillna(0, ["n_files"])


def inline_source(spark: SparkSession, text: str, file_path: str = "inline") -> DataFrame:
    """One text given as a string."""
    return spark.createDataFrame([(0, file_path, text, None)], SOURCE_SCHEMA)


def with_extension(df: DataFrame, path_col: str, extensions: list[str]) -> DataFrame:
    return df.where(tx.suffix(path_col).isin(extensions))
