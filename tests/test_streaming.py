"""Streams against batch, and files processed once."""

import json
import os

import pyarrow as pa

from lintmill.operators import findings as found
from lintmill.operators import lineage
from lintmill.sources import readers
from lintmill.streaming import ingest
from lintmill.streaming.log_source import LogReader, _line_batches
from tests.conftest import rows

FIRST = "a.py:1:1: error: [sql] one\na.py:2:1: warning: two\n"
SECOND = "a.py:3:1: error: three\nb.py:1:1: info: four\n"


def test_logs_as_they_arrive(spark, tmp_path):
    logs, out, counts = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "counts")
    logs.mkdir()
    hidden = "c.py:1:1: error: five\r\nc.py:2:2: warning: é"
    for name, text, total in (("1.txt", FIRST, 2), ("_a.txt", SECOND, 4), (None, None, 4), (".b.log", hidden, 6), ("0.txt", "", 6)):
        if name:
            (logs / name).write_text(text)
        stream = ingest.lint_stream(spark, str(logs))
        ingest.write_findings(stream, out, str(tmp_path / "c1")).awaitTermination()
        ingest.write_severity_counts(stream, counts, str(tmp_path / "c2")).awaitTermination()
        assert spark.read.parquet(out).count() == total
    batch = readers.scan_lint(spark, str(logs))
    columns = ["file_path", "line_number", "severity", "category", "message"]
    assert rows(spark.read.parquet(out), *columns) == rows(batch, *columns)
    same = ["file_path", "severity", "findings"]
    assert rows(ingest.latest_counts(spark, counts), *same) == rows(found.severity_counts(batch), *same)


def test_files_of_one_instant_and_late_files(spark, tmp_path):
    reader = LogReader({"path": str(tmp_path), "max_age": "100"})
    read = lambda a, b: sorted(r for p in reader.partitions(a, b) for t in reader.read(p) for r in t["raw"].to_pylist())
    offsets, batches = [reader.initialOffset()], []
    for name, time in (("b", 1000), ("a", 1000), ("_late", 950), (".old", 100), ("new", 1200)):
        (tmp_path / name).write_text(f"{name}\n")
        os.utime(tmp_path / name, (time, time))
        offsets.append(reader.latestOffset())
        batches.append(read(*offsets[-2:]))
    assert batches == [["b"], ["a"], ["_late"], [], ["new"]]
    assert [read(a, b) for a, b in zip(offsets[1:], offsets[2:])] == batches[1:]  # retried
    assert json.loads(json.dumps(offsets)) == offsets


def test_lines_are_cut_like_text():
    text = b"one\r\ntwo\rthree\n\n" + b"x" * (1 << 20) + b"\r\nlast"
    lines = [line for batch in _line_batches(pa.BufferReader(text)) for line in batch]
    assert lines == ["one", "two", "three", "", "x" * (1 << 20), "last"]


def test_new_files_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "file string, code string"
    for n in (1, 2, 2):
        code = spark.createDataFrame([(f"f{n}.py", f"c.execute('UPDATE t{n} SET a=1')")], schema)
        if not (source / f"{n}").exists():
            code.write.parquet(str(source / f"{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        ingest.process_new_files(stream, lineage.edges, out, str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(out).count() == n
