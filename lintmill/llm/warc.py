"""WARC archives as a Spark data source, with identical payloads as revisits.

``warc`` reads and writes archives with one gzip member per record. A member
written here tells its own length in a gzip extra field, so that a reader steps
over a record after its headers without inflating the payload; archives made by
others are inflated and discarded piece by piece. The reader plans file
partitions, takes predicates on record type and headers, parses the headers of
every record first and decodes the payload only of those that pass (and of none
with option payload=false).

Writing commits as Spark's file writers do: tasks write files of their own, and
those of the attempts that counted are listed in the commit. Paths are URIs of a
file system that pyarrow.fs opens on executors.

Edge cases: a NULL text is an empty payload; a NULL url has no target header;
line breaks in header values become spaces. Among rows with equal payloads those
with the largest id are the responses (repeated rows of that id are all kept so);
a NULL id is below all others, and if all are NULL all stay responses. Payloads
below ``least_bytes`` are always responses. Empty tables give empty archives, and
other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes long, headers map<string,string>, payload binary"
)
ARROW = pa.schema([
    ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
    ("payload", pa.binary()),
])
HEADERS = {  # column: header
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LISTING = re.compile(r"_files.*\.json")  # one for each commit, all of them read
FILE_BYTES = 64 << 20        # a task starts a new file beyond this
PARTITION_BYTES = 128 << 20  # archives that one task reads, if they are smaller
STEP = 1 << 16
EXTRA = struct.Struct("<HBBHQ")  # length of all extra fields; "LM", length, length of the member


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def member(content: bytes) -> bytes:
    """A gzip member that tells its own length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    size = 10 + EXTRA.size + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + EXTRA.pack(EXTRA.size - 2, ord("L"), ord("M"), 8, size)
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def record(values: dict) -> bytes:
    """One WARC record: WARC headers, then an HTTP response with the payload."""
    payload = values["payload"] or b""
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        if values.get(column) is not None:
            lines.append(f"{name}: {' '.join(str(values[column]).split())}")
    if values["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + http + payload + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip(): value.strip() for name, _, value in pairs}


@dataclass
class _Task(InputPartition):
    files: list[str]


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


class WarcSource(DataSource):
    """Archives below ``path``. Options: payload (true), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], schema.names, overwrite)


def _listings(system: fs.FileSystem, root: str) -> list[str]:
    """Lists of the files of all commits to a folder."""
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in found if i.type == fs.FileType.File and LISTING.fullmatch(i.base_name))


def _listed(system: fs.FileSystem, listings: list[str]) -> list[tuple[str, int]]:
    found = []
    for path in listings:
        with system.open_input_stream(path) as listing:
            found.extend((name, size) for name, size in json.loads(listing.read()))
    return found


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path.rstrip("/"), names, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        out, done, name = None, _Written(), ""
        for batch in iterator:
            for values in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member(record(values)))
                if out.tell() >= FILE_BYTES:
                    done.files.append((name, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.files.append((name, out.tell()))
            out.close()
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        before = _listings(system, root) if self.overwrite else []
        old = _listed(system, before)
        listed = [f for m in messages if m for f in m.files]
        with system.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())
        for path in [*before, *(f"{root}/{name}" for name, _ in old)]:
            system.delete_file(path)

    def abort(self, messages: list[_Written | None]) -> None:
        system, root = file_system(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            system.delete_file(f"{root}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: dict[str, set] = {}  # header: values that pass

    def pushFilters(self, filters: list) -> Iterator:
        """Equality on header columns is checked before anything is decoded."""
        for one in filters:
            column = one.attribute[0] if isinstance(one, (EqualTo, In)) and len(one.attribute) == 1 else None
            if column in HEADERS and column not in ("payload_bytes", "payload_digest"):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                name = HEADERS[column]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield one

    def partitions(self) -> list[_Task]:
        system, root = file_system(self.path)
        listings = _listings(system, root)
        if listings:
            found = [(f"{root}/{name}", size) for name, size in _listed(system, listings)]
        else:
            infos = system.get_file_info(fs.FileSelector(root, recursive=True))
            found = [(i.path, i.size) for i in infos if i.path.endswith((".warc", ".warc.gz"))]
        tasks, size = [_Task([])], 0
        for path, length in sorted(found):
            if tasks[-1].files and size + length > self.partition_bytes:
                tasks.append(_Task([]))
                size = 0
            tasks[-1].files.append(path)
            size += length
        return tasks

    def read(self, partition: _Task) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows, size = [], 0
        for path in partition.files:
            with system.open_input_file(path) as source:
                for row in self._records(source):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 512
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _passes(self, headers: dict[str, str]) -> bool:
        return all(headers.get(name) in values for name, values in self.wanted.items())

    def _records(self, source) -> Iterator[dict]:
        size, at = source.size(), 0
        while at < size:
            source.seek(at)
            start = source.read(10 + EXTRA.size)
            if start[:2] != b"\x1f\x8b":
                at, row = self._plain(source, at)
            elif len(start) == 10 + EXTRA.size and start[3] == 4 and start[12:14] == b"LM":
                length = EXTRA.unpack(start[10:])[4]
                row = self._sized(source, at + len(start), length - len(start) - 8)
                at += length
            else:
                at, row = self._streamed(source, at)
            if row is not None:
                yield row

    def _sized(self, source, at: int, length: int) -> dict | None:
        """A member of known length: inflate no more than its headers if it does not pass."""
        source.seek(at)
        unpacker, head, taken = zlib.decompressobj(-15), b"", 0
        while b"\r\n\r\n" not in head and taken < length:
            piece = source.read(min(2048, length - taken))
            taken += len(piece)
            head += unpacker.decompress(unpacker.unconsumed_tail + piece)
        lines, _, rest = head.partition(b"\r\n\r\n")
        headers = parse_headers(lines)
        if not self._passes(headers):
            return None
        if not self.payload:
            return self._row(headers, None)
        source.seek(at + taken)
        return self._row(headers, rest + unpacker.decompress(unpacker.unconsumed_tail + source.read(length - taken)))

    def _streamed(self, source, at: int) -> tuple[int, dict | None]:
        """A member of unknown length: inflate in pieces, keep them only if wanted."""
        source.seek(at)
        unpacker, head, kept, headers, taken = zlib.decompressobj(31), b"", [], None, 0
        while not unpacker.eof:
            piece = source.read(STEP)
            if not piece:
                break
            taken += len(piece)
            out = unpacker.decompress(piece)
            if headers is None:
                head += out
                if b"\r\n\r\n" not in head:
                    continue
                lines, _, out = head.partition(b"\r\n\r\n")
                headers = parse_headers(lines)
                wanted = self._passes(headers)
            if wanted and self.payload:
                kept.append(out)
        at += taken - len(unpacker.unused_data)
        if headers is None or not wanted:
            return at, None
        return at, self._row(headers, b"".join(kept) if self.payload else None)

    def _plain(self, source, at: int) -> tuple[int, dict | None]:
        """A record that is not compressed."""
        source.seek(at)
        head = b""
        while b"\r\n\r\n" not in head:
            piece = source.read(STEP)
            if not piece:
                return source.size(), None
            head += piece
        lines = head.partition(b"\r\n\r\n")[0]
        headers = parse_headers(lines)
        begin, length = at + len(lines) + 4, int(headers.get("Content-Length", 0))
        row = None
        if self._passes(headers):
            source.seek(begin)
            row = self._row(headers, source.read(length) if self.payload else None)
        return begin + length + 4, row

    def _row(self, headers: dict[str, str], block: bytes | None) -> dict:
        if block is not None:
            block = block[:int(headers.get("Content-Length", len(block)))]
            if headers.get("Content-Type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
        row = {column: headers.get(name) for column, name in HEADERS.items()}
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
        row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else None
        return row | {"headers": list(headers.items()), "payload": block}


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives below a path. Equality on header columns is pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_archive(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows with the columns of SCHEMA (headers are made from the others).

    Records are added to those below the path, or replace them with ``overwrite``.
    """
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode(mode).save(path)


def page_records(
    pages: DataFrame, id_column: str = "page_id", url: str = "url", text: str = "html", least_bytes: int = 1000
) -> DataFrame:
    """A record per page; of pages with equal payloads all but the largest id revisit it."""
    held = pages.select(
        F.col(f"`{id_column}`").cast("string").alias("page"), F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{url}`").alias("target_uri"),
        F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "utf-8").alias("payload"),
    )
    held = held.withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"),
        "check": F.xxhash64("payload"),
    })
    key = ["digest", "check", "payload_bytes"]
    groups = (
        held.filter(F.col("payload_bytes") >= least_bytes).groupBy(*key)
        .agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c, F.lit("")), F.lit(">"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return held.join(groups, key, "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("page")).alias("record_id"),
        F.when(again, urn(F.col("first").cast("string"))).alias("refers_to"), "target_uri",
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), "payload_bytes",
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_of(urn: str):
    """The page id in a record's URN."""
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:x-page:(.*)>$', 1) as long)")
