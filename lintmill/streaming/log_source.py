"""A streaming source of log lines that sees every file of a folder, whatever its name.

Spark's own file stream hides names that start with ``_`` or ``.``. An offset here is
the newest modification time seen, and the names (hashed) of the files seen of the last
``max_age`` seconds before it. So files of one instant are told apart, and a file that
turns up late is read if it is not older than that; older ones count as seen. A batch
is planned from a listing and two offsets alone, so a batch that is retried is the same
while its files are there (the very first one also takes files of old date that turned
up since).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lintmill.sources.paths import file_system

MAX_AGE = 7 * 24 * 3600  # seconds
TASK_BYTES = 64 << 20    # of files, for one task
BATCH = 10_000           # lines sent at once
SCHEMA = "seq struct<source: string, block: bigint, row: bigint>, raw string"
_LINES = pa.schema([
    ("seq", pa.struct([("source", pa.string()), ("block", pa.int64()), ("row", pa.int64())])), ("raw", pa.string()),
])


@dataclass
class _Files(InputPartition):
    paths: list[str]


class LogSource(DataSource):
    """Lines of the files in ``path``, as they arrive."""

    @classmethod
    def name(cls) -> str:
        return "lint_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogReader(self.options)


def _mark(path: str) -> str:
    return hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.max_age = int(float(options.get("max_age", MAX_AGE)) * 1e9)

    def initialOffset(self) -> dict:
        return {"time": -1, "seen": []}

    def latestOffset(self) -> dict:
        found = self._found()
        newest = max((time for _, time, _ in found), default=-1)
        return {"time": newest, "seen": sorted(_mark(path) for path, time, _ in found if time > newest - self.max_age)}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        before, until = self._covered(start), self._covered(end)
        tasks, size = [], TASK_BYTES
        for path, time, length in sorted(self._found()):
            if until(path, time) and not before(path, time):
                if size >= TASK_BYTES:
                    tasks.append(_Files([]))
                    size = 0
                tasks[-1].paths.append(path)
                size += length
        return tasks

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, prefix, _ = file_system(self.path)
        for path in partition.paths:
            source = f"file://{path}" if not prefix else prefix + path
            with system.open_input_stream(path) as opened:  # compressed files by their names
                for number, lines in enumerate(_line_batches(opened)):
                    place = [{"source": source, "block": 0, "row": number * BATCH + i} for i in range(len(lines))]
                    yield pa.RecordBatch.from_pydict({"seq": place, "raw": lines}, schema=_LINES)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""

    def _covered(self, offset: dict):
        seen, oldest = set(offset["seen"]), offset["time"] - self.max_age
        return lambda path, time: time <= oldest or _mark(path) in seen

    def _found(self) -> list[tuple[str, int, int]]:
        system, _, inner = file_system(self.path)
        if system.get_file_info(inner).type == fs.FileType.File:
            infos = [system.get_file_info(inner)]
        else:
            infos = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return [(i.path, i.mtime_ns or 0, i.size or 0) for i in infos if i.type == fs.FileType.File]


def _line_batches(opened: pa.NativeFile) -> Iterator[list[str]]:
    """Lines, as Spark's text source cuts them, some thousands at a time."""
    held, lines = b"", []
    while True:
        piece = opened.read(1 << 20)
        held += piece
        if piece and held.endswith(b"\r"):
            continue  # a line feed may follow
        cut = held.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        held = cut.pop() if piece else b""
        if not piece and cut and not cut[-1]:
            cut.pop()
        lines.extend(line.decode("utf-8", "replace") for line in cut)
        while len(lines) >= BATCH or (lines and not piece):
            yield lines[:BATCH]
            del lines[:BATCH]
        if not piece:
            return
