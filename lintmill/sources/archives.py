"""Members of zip archives, read from their byte ranges in many tasks.

An archive ends with a directory of its members. One pass over the archives reads these
directories alone (a few seeks each) and gives a row for every member, with where it
lies. Members that lie next to each other are put into parts of about ``PART_BYTES``
of the archive, and the parts are dealt to tasks, so one large archive is unpacked by
many tasks and no task holds an archive. What goes through the driver is counts.

A task holds one member at a time, and the directory of one archive (some hundred
bytes a member). What cannot be read is a row with the reason and no content.
"""

from __future__ import annotations

import bz2
import io
import itertools
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.session import materialize
from lintmill.sources.paths import file_system

PART_BYTES = 8 << 20  # of an archive, for one part
ROWS = 10_000         # members sent at once

_PLACES = "archive string, member string, part long, start long, packed long, method int, sealed boolean, crc long, reason string"
MEMBERS = "path string, content binary, reason string"
_LOCAL_HEADER = 30  # bytes; two lengths of what follows are its last fields
_UNREADABLE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError)


class _Seekable(io.RawIOBase):
    """An Arrow file that says OSError, as zipfile expects, where a place before its start is asked for."""

    def __init__(self, opened: pa.NativeFile):
        self._opened = opened

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._opened.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.tell(), io.SEEK_END: self._opened.size()}[whence]
        if place < 0:
            raise OSError("before the start of the archive")
        return self._opened.seek(place)

    def readinto(self, buffer) -> int:
        return self._opened.readinto(buffer)


def _places(batches: Iterator[pa.RecordBatch], extension: str, part_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch["path"].to_pylist():
            system, _, inner = file_system(archive)
            rows = []
            try:
                with system.open_input_file(inner) as opened, zipfile.ZipFile(_Seekable(opened)) as directory:
                    found = sorted(directory.infolist(), key=lambda i: i.header_offset)
            except (zipfile.BadZipFile, NotImplementedError) as error:
                found = []
                rows.append((archive, None, 0, 0, 0, 0, False, 0, f"not an archive: {error}"))
            for info in found:
                if info.is_dir() or not info.filename.endswith(extension):
                    continue
                rows.append((archive, info.filename, info.header_offset // part_bytes, info.header_offset,
                             info.compress_size, info.compress_type, bool(info.flag_bits & 1), info.CRC, None))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string())
    names = [field.split()[0] for field in _PLACES.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _unpacked(opened: BinaryIO, row: dict) -> bytes:
    """A member's bytes, from its own range of the archive."""
    if row["sealed"]:
        raise RuntimeError("encrypted")
    opened.seek(row["start"])
    header = opened.read(_LOCAL_HEADER)
    if len(header) < _LOCAL_HEADER or not header.startswith(b"PK\x03\x04"):
        raise zipfile.BadZipFile("no member where the directory says")
    opened.seek(row["start"] + _LOCAL_HEADER + sum(struct.unpack("<HH", header[-4:])))
    packed = opened.read(row["packed"])
    if len(packed) < row["packed"]:
        raise EOFError("the archive ends within the member")
    if row["method"] == zipfile.ZIP_STORED:
        content = packed
    elif row["method"] == zipfile.ZIP_DEFLATED:
        content = zlib.decompress(packed, -zlib.MAX_WBITS)
    elif row["method"] == zipfile.ZIP_BZIP2:
        content = bz2.decompress(packed)
    else:
        raise NotImplementedError(f"compression method {row['method']}")
    if zlib.crc32(content) != row["crc"]:
        raise zipfile.BadZipFile("its checksum differs")
    return content


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, opened = None, None
    for batch in batches:
        for row in batch.to_pylist():
            path = row["archive"] if row["member"] is None else f"{row['archive']}!/{row['member']}"
            content, reason = None, row["reason"]
            if reason is None:
                if row["archive"] != archive:
                    if opened is not None:
                        opened.close()
                    system, _, inner = file_system(row["archive"])
                    archive, opened = row["archive"], system.open_input_file(inner)
                try:
                    content = _unpacked(opened, row)
                except _UNREADABLE as error:
                    reason = f"cannot be unpacked: {error}"
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([path], pa.string()), "content": pa.array([content], pa.binary()),
                "reason": pa.array([reason], pa.string())})
    if opened is not None:
        opened.close()


def members(archives: DataFrame, extension: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Members (path, content, reason) of the archives named by ``path``.

    A member's path is ``<archive>!/<name>``. Two members of one name are two rows.
    """
    spark = archives.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    listed = archives.select("path").repartition(tasks, "path")
    placed = materialize(listed.mapInArrow(lambda b: _places(b, extension, part_bytes), _PLACES), "members")
    parts = placed.select("archive", "part").distinct().count()
    return (
        placed.repartition(max(1, min(parts, max(tasks, -(-parts * part_bytes // (128 << 20))))), "archive", "part")
        .sortWithinPartitions("archive", "start").mapInArrow(_contents, MEMBERS)
    )


def pack(files: DataFrame, folder: str, per_archive: int = 1000) -> None:
    """Write files (path, content) as zip archives, ``per_archive`` to each, below a folder all tasks reach.

    Files are compressed as they come. An archive's name tells its task, so a task that
    runs again replaces its archives; each is moved to its name when it is whole.
    """
    system, _, inner = file_system(folder)
    system.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, _, inner = file_system(folder)
        rows = (row for batch in batches for row in batch.to_pylist())
        for number in itertools.count():
            row = next(rows, None)
            if row is None:
                return
            name = f"{context.partitionId():06}-{number:06}"
            unfinished = f"{inner}/.{name}-{context.taskAttemptId()}"
            with system.open_output_stream(unfinished) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for one in itertools.chain([row], itertools.islice(rows, per_archive - 1)):
                    archive.writestr(one["path"], one["content"])
            system.move(unfinished, f"{inner}/{name}.zip")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    content = F.coalesce("content", F.lit("")).alias("content")
    files.select("path", content).mapInArrow(write, "name string").count()
