"""Logs of answer lines that still grow, as a source of streams that can be replayed.

Spark's own file source takes a file once, when it first sees it. Here the offset of a stream is the end of
the last whole line of each file, so lines that are added later are read then, from where the last
micro-batch ended. A micro-batch is a list of byte ranges and reads the same lines however often it runs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "answer_log"
SCHEMA = "file string, at bigint, line string"
SPLIT_BYTES = 64 << 20
TAIL_BYTES = 1 << 16
BATCH_BYTES = 4 << 20
BATCH_LINES = 10_000


@dataclass
class Range(InputPartition):
    """Bytes of a file. It owns the lines that start in it; `begin` is where a line is known to start."""

    file: str
    begin: int
    start: int
    end: int

    def __post_init__(self):
        super().__init__(None)


class Logs:
    """The files below a folder; names that start with `_` or `.` are left out, as by Spark's readers."""

    def __init__(self, options: dict):
        path = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        if path.startswith("file:"):
            path = "/" + path[len("file:") :].lstrip("/")
        self.system, self.root = (
            fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        )
        self.known: dict[str, tuple[int, int]] = {}

    def ends(self) -> dict[str, int]:
        """The end of the last whole line of each file. Only files that grew are opened, at their end."""
        found = {}
        selector = fs.FileSelector(self.root, recursive=True, allow_not_found=True)
        for info in self.system.get_file_info(selector):
            name = info.path[len(self.root) :].lstrip("/")
            if info.type != fs.FileType.File or any(p[0] in "_." for p in name.split("/")):
                continue
            size, end = self.known.get(name, (0, 0))
            if info.size != size:
                end = self._last_line_end(name, info.size)
                self.known[name] = info.size, end
            if end > 0:
                found[name] = end
        return found

    def _last_line_end(self, name: str, size: int) -> int:
        with self.system.open_input_file(f"{self.root}/{name}") as file:
            while size > 0:
                start = max(0, size - TAIL_BYTES)
                file.seek(start)
                place = file.read(size - start).rfind(b"\n")
                if place >= 0:
                    return start + place + 1
                size = start
        return 0

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        """What lies between two offsets, in ranges of at most `split` bytes."""
        found = []
        for name, until in sorted(end.items()):
            begin = start.get(name, 0)
            if until < begin:
                raise ValueError(f"{name} is shorter than what was read of it: {until} of {begin} bytes")
            found += [
                Range(name, begin, at, min(at + self.split, until)) for at in range(begin, until, self.split)
            ]
        return found

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        places, lines, size = [], [], 0
        with io.BufferedReader(self.system.open_input_file(f"{self.root}/{part.file}"), 1 << 20) as file:
            at = part.start
            if at > part.begin:
                # The line that is under way belongs to the range before; one byte back tells if there is one.
                file.seek(at - 1)
                at += len(file.readline()) - 1
            else:
                file.seek(at)
            while at < part.end:
                line = file.readline()
                if not line:
                    raise OSError(f"{part.file} ends at {at}, before {part.end}")
                places.append(at)
                lines.append(line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                at += len(line)
                size += len(line)
                if size >= BATCH_BYTES or len(lines) == BATCH_LINES:
                    yield _batch(part.file, places, lines)
                    places, lines, size = [], [], 0
        if lines:
            yield _batch(part.file, places, lines)


def _batch(name: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
    columns = [pa.array([name] * len(lines)), pa.array(places, pa.int64()), pa.array(lines, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["file", "at", "line"])


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.logs = Logs(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.logs.ends()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.logs.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.logs.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: logs are kept by whoever writes them."""


class LogTable(DataSourceReader):
    def __init__(self, options: dict):
        self.logs = Logs(options)

    def partitions(self) -> list[Range]:
        return self.logs.ranges({}, self.logs.ends())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.logs.read(partition)


class AnswerLog(DataSource):
    """`spark.readStream.format("answer_log").load(folder)`, or `spark.read` for what is there now."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)

    def reader(self, schema) -> LogTable:
        return LogTable(self.options)


def log_lines(
    spark: SparkSession, folder: str, streaming: bool = True, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """`(file, at, line)`: the lines of the logs below `folder` and the byte each starts at.

    Only whole lines are read; what follows the last line feed waits until it is finished. `\\r\\n` ends a
    line too, bytes that are no UTF-8 become replacement signs, blank lines are lines. A folder without
    files, or none yet, has no rows. A log that got shorter is an error, as its lines could not be replayed.
    The offset holds one number per file, so logs should be few and long rather than one per answer.
    """
    spark.dataSource.register(AnswerLog)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    source = spark.readStream if streaming else spark.read
    return source.format(FORMAT).option("splitBytes", split_bytes).load(system.makeQualified(path).toString())


def pieces(lines: DataFrame) -> DataFrame:
    """`(question_id, seq, line)` of log lines `{"question_id": 1, "seq": 0, "line": "..."}`.

    Lines that are no such object, or lack a number, are no pieces of any answer and drop out.
    """
    piece = F.from_json("line", "question_id bigint, seq bigint, line string")
    return lines.select(piece.alias("p")).select("p.*").where("question_id is not null and seq is not null")
