"""Session defaults and the shared work folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

_local_dir: str | None = None


def get_session(app_name: str = "fieldtrace", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for; `conf` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        # What `hold` wrote goes when nothing refers to it.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Bounds what a batch of long texts takes in a Python worker.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Where the setting is missing a temporary folder is used, in local mode only: on a cluster a
    machine-local folder would be lost with its machine.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_dir is None or not os.path.isdir(_local_dir):
        _local_dir = tempfile.mkdtemp(prefix="fieldtrace-")
    return _local_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the work folder nothing else writes to."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def passing_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared work folder, which goes when the session's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, name))
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    # A path without a scheme is one of the default file system, here as in Spark's own writers.
    where = system.makeQualified(where)
    system.deleteOnExit(where)
    return where.toString()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI in the shared folder, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def hold(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, for a table several joins read.

    A reliable checkpoint: survives lost executors and keeps the hash partitioning of `df`.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def small(
    held: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """A held table, marked for broadcast if its rows and then their bytes (as JSON) are few.

    Beyond that the join is left to Spark, which shuffles both sides.
    """
    if held.count() > max_rows:
        return held
    size = held.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(held) if size <= max_bytes else held


def ship(spark: SparkSession, *folders: str) -> None:
    """Sends this package, and packages in other folders, to the Python workers.

    For sessions that were started without `--py-files`. The archives go through the shared folder.
    """
    context = spark.sparkContext
    shipped = context.__dict__.setdefault("_fieldtrace_shipped", set())
    for folder in (os.path.dirname(os.path.abspath(__file__)), *folders):
        if folder not in shipped:
            path = f"{new_path(spark, 'package')}/{os.path.basename(folder)}.zip"
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
            out.write(_archive(folder))
            out.close()
            context.addPyFile(path)
            shipped.add(folder)


def _archive(folder: str) -> bytes:
    root, data = os.path.dirname(folder), io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for at, _, names in os.walk(folder):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    archive.write(path, os.path.relpath(path, root))
    return data.getvalue()
