"""Reading source files, notebooks, archives and lint logs."""

from __future__ import annotations

import fnmatch
import functools
import logging
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill import schemas
from lintmill.functions.text import base_name, clean_utf8, is_code, split_lines, universal_newlines
from lintmill.operators.findings import parse_findings
from lintmill.session import materialize
from lintmill.sources import archives
from lintmill.sources.paths import file_system, known_store

log = logging.getLogger(__name__)

READ_BYTES = 128 << 20  # of whole files, for one task
_NOTEBOOK = T.StructType([
    T.StructField("cells", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def _load(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame | None:
    """The source, or None (and a logged error) where the path does not exist."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.error("input not found: %s", path)
        return None


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch["path"].to_pylist():
            system, prefix, inner = file_system(folder)
            found = [i for i in system.get_file_info(fs.FileSelector(inner)) if i.type != fs.FileType.NotFound]
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([prefix + i.path for i in found], pa.string()),
                "folder": pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_()),
                "length": pa.array([i.size or 0 for i in found], pa.int64()),
            })


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["path"].to_pylist():
            system, _, inner = file_system(path)
            with system.open_input_stream(inner, compression=None) as opened:
                yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([opened.read()], pa.binary())})


def _listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame | None:
    """Files (path, length) of a folder, whatever their names; None (and a logged error) if it is missing.

    Spark's own listing hides names that start with ``_`` or ``.``, so folders are
    listed in tasks, a job for each level. Patterns and stores that Arrow does not
    know are left to Spark's listing, which is logged.
    """
    if not known_store(path):
        log.warning("listed by Spark, without names that start with _ or '.': %s", path)
        listed = _load(spark, path, "binaryFile", recursiveFileLookup=str(recursive).lower())
        return None if listed is None else listed.select(_plain_path(F.col("path")).alias("path"), "length")
    system, prefix, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        log.error("input not found: %s", path)
        return None
    if info.type == fs.FileType.File:
        return spark.createDataFrame([(prefix + inner, info.size)], "path string, length long")
    folders, levels = spark.createDataFrame([(prefix + inner,)], "path string"), []
    while True:
        level = materialize(folders.mapInArrow(_list_folders, "path string, folder boolean, length long"), "listing")
        levels.append(level.filter("not folder").select("path", "length"))
        folders = level.filter("folder").select("path")
        if not recursive or folders.isEmpty():
            return functools.reduce(DataFrame.union, levels)
        folders = folders.repartition(spark.sparkContext.defaultParallelism, "path")


def _contents(listed: DataFrame) -> DataFrame:
    """Whole files (path, content), read in about READ_BYTES a task."""
    spark = listed.sparkSession
    size = listed.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    return listed.select("path").repartition(tasks, "path").mapInArrow(_read_files, "path string, content binary")


def _whole_files(spark: SparkSession, path: str, extension: str, recursive: bool = False) -> DataFrame | None:
    listed = _listing(spark, path, recursive)
    return None if listed is None else _contents(listed.filter(F.col("path").endswith(extension)))


def _as_python_files(raw: DataFrame) -> DataFrame:
    lines = split_lines(F.col("content"))
    return raw.withColumn("lines", lines).select(
        base_name(F.col("path")).alias("filename"), "path", "content", "lines",
        F.size("lines").alias("line_count"),
        F.size(F.filter("lines", is_code)).alias("code_line_count"),
        F.lit("python").alias("file_type"),
    )


def scan_python(spark: SparkSession, path: str) -> DataFrame:
    """The ``*.py`` files of one folder; files that are not UTF-8 are skipped."""
    raw = _whole_files(spark, path, ".py")
    if raw is None:
        return spark.createDataFrame([], schemas.FILE)
    text = F.col("content").cast("string")
    return _as_python_files(
        raw.filter(F.is_valid_utf8(text)).select("path", universal_newlines(text).alias("content"))
    )


def scan_tree(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.py`` files below a folder; invalid bytes are dropped."""
    raw = _whole_files(spark, path, ".py", recursive=True)
    if raw is None:
        return spark.createDataFrame([], schemas.FILE)
    return _as_python_files(
        raw.select("path", universal_newlines(clean_utf8(F.col("content"))).alias("content"))
    )


def skipped_inputs(spark: SparkSession, path: str) -> DataFrame:
    """What the scans of a folder leave out, and why: (path, reason)."""
    listed = _listing(spark, path)
    if listed is None:
        return spark.createDataFrame([], "path string, reason string")
    of = lambda extension: _contents(listed.filter(F.col("path").endswith(extension)))
    text = F.col("content").cast("string")
    parsed = F.from_json(text, _NOTEBOOK, {"mode": "PERMISSIVE"}).isNotNull() & F.get_json_object(text, "$").isNotNull()
    unread = F.when(~F.is_valid_utf8(text), "not UTF-8")
    found = of(".py").select("path", unread.alias("reason")).union(
        of(".ipynb").select("path", unread.when(~parsed, "not a notebook").alias("reason"))
    ).union(archives.members(listed.filter(F.col("path").endswith(".zip")), ".py").select("path", "reason"))
    return found.filter("reason is not null")


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    """The ``.py`` members of zip archives, unpacked in many tasks an archive; invalid bytes are dropped."""
    listed = _listing(spark, path)
    if listed is None:
        return spark.createDataFrame([], schemas.FILE)
    found = archives.members(listed.filter(F.col("path").endswith(".zip")), ".py").filter("reason is null")
    return _as_python_files(
        found.select("path", universal_newlines(clean_utf8(F.col("content"))).alias("content"))
    )


def normal_source(cell: Column) -> Column:
    """Source of a cell, given as JSON text, as an array of lines.

    The source may be a list, whose elements keep their line ends, or plain text,
    which is split at line ends.
    """
    listed = F.from_json(cell, "source array<string>")["source"]
    text = F.from_json(cell, "source string")["source"]
    return F.coalesce(listed, split_lines(text), F.expr("cast(array() as array<string>)"))


def parse_notebooks(raw: DataFrame) -> DataFrame:
    """Notebook JSON texts ``(path, content)`` to notebook rows; broken ones drop out."""
    # source may be text or a list, so it is first read as the JSON text it is.
    cells = F.transform("_nb.cells", lambda c: F.struct(
        F.get_json_object(c, "$.cell_type").alias("cell_type"),
        normal_source(c).alias("source"),
        c.alias("raw"),
    ))
    return (
        raw.withColumn("_nb", F.from_json("content", _NOTEBOOK, {"mode": "PERMISSIVE"}))
        .filter(F.get_json_object("content", "$").isNotNull() & F.col("_nb").isNotNull())
        .withColumn("cells", F.coalesce(cells, F.array().cast(T.ArrayType(schemas.CELL))))
        .select(
            base_name(F.col("path")).alias("filename"), "path", "content", "cells",
            F.coalesce("_nb.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
            F.size("cells").alias("cell_count"),
            F.size(F.filter("cells", lambda c: c["cell_type"] == "code")).alias("code_cell_count"),
            F.lit("notebook").alias("file_type"),
        )
    )


def scan_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """The ``*.ipynb`` files of one folder."""
    raw = _whole_files(spark, path, ".ipynb")
    if raw is None:
        return spark.createDataFrame([], schemas.NOTEBOOK)
    text = F.col("content").cast("string")
    return parse_notebooks(raw.filter(F.is_valid_utf8(text)).select("path", text.alias("content")))


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """One row per cell: (path, cell_index, cell_type, source, raw)."""
    return notebooks.select("path", F.posexplode("cells").alias("cell_index", "_c")).select(
        "path", "cell_index", "_c.cell_type", "_c.source", "_c.raw"
    )


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select("path", F.posexplode("lines").alias("_pos", "line")).select(
        "path", (F.col("_pos") + 1).alias("line_no"), "line"
    )


def entries(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """The first ``n`` files of a folder by name, for display."""
    listed = _listing(spark, path)
    if listed is None:
        return spark.createDataFrame([], "path string, length long")
    return listed.orderBy("path").limit(n)


def preview(files: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` lines of each file, for display."""
    return files.select("path", F.array_join(F.slice("lines", 1, n), "\n").alias("preview"))


def with_cell_counts(files: DataFrame) -> DataFrame:
    """Python files carry no cells; their counts are 0."""
    return files.withColumns({"cell_count": F.lit(0), "code_cell_count": F.lit(0)})


def log_position() -> Column:
    """Orders log lines: by file, by split, by place within the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def scan_lint(spark: SparkSession, path: str) -> DataFrame:
    """Lint logs to findings; ``seq`` keeps the input order.

    Logs are splittable, but for those whose names Spark's listing hides
    (``_...`` and ``....``): these are read whole.
    """
    raw = _load(spark, path, "text")
    if raw is None:
        return spark.createDataFrame([], schemas.FINDING)
    log_lines = raw.select(log_position().alias("seq"), F.col("value").alias("raw"))
    hidden = _listing(spark, path).filter(base_name(F.col("path")).rlike(r"^[_.]"))
    if not hidden.isEmpty():
        source = F.when(F.col("path").startswith("/"), F.concat(F.lit("file://"), "path")).otherwise(F.col("path"))
        lines = split_lines(universal_newlines(clean_utf8(F.col("content"))))
        rows = _contents(hidden).select(source.alias("source"), F.posexplode(lines).alias("row", "raw"))
        log_lines = log_lines.union(rows.select(
            F.struct("source", F.lit(0).cast("long").alias("block"), F.col("row").cast("long").alias("row")), "raw"))
    return parse_findings(log_lines)


def preflight(spark: SparkSession, folder: str, lint_path: str, pattern: str = "*.py") -> DataFrame:
    """What is missing before a run: (check, ok, message). Reads listings only.

    The listings are those of the scans, so files count whatever their names.
    """
    listed, logs = _listing(spark, folder), _listing(spark, lint_path)
    there = listed is not None
    wanted = base_name(F.col("path")).rlike(fnmatch.translate(pattern))
    any_file = there and not listed.filter(wanted).isEmpty()
    log_there = logs is not None and not logs.isEmpty()
    rows = [
        ("folder", there, "" if there else f"Input folder does not exist: {folder}"),
        ("files", any_file, "" if any_file else f"No files like {pattern} found in: {folder}"),
        ("log", log_there, "" if log_there else f"Lint file does not exist: {lint_path}"),
    ]
    return spark.createDataFrame(rows, "check string, ok boolean, message string")
