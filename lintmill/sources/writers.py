"""Writing result tables and converted files."""

from __future__ import annotations

import itertools
import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.functions.text import base_name, strings
from lintmill.operators.apply import converted_name
from lintmill.session import materialize
from lintmill.sources.paths import file_system


def write_json(tables: dict[str, DataFrame], root: str) -> None:
    """One JSON folder per table."""
    for name, df in tables.items():
        df.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").json(f"{root}/{name}")


def _with_target(converted: DataFrame, name: Column, root: str | None) -> DataFrame:
    """Adds ``target``: the folder of ``path`` below ``root``, and the name.

    ``root`` is the folder all paths share where none is given. Steps up
    ("..", as archives may hold) are not followed.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    if root is None:
        ends = [e or "" for e in converted.agg(F.min(folder), F.max(folder)).first()]
        root = os.path.commonprefix(ends).rpartition("/")[0]
    root = root.rstrip("/") + "/"
    below = F.when(folder.startswith(root), F.substr(folder, F.lit(len(root) + 1))).otherwise(folder)
    below = F.regexp_replace(F.regexp_replace(below, r"(?<![^/])\.\.(?![^/])", "_"), "^/+", "")
    return converted.withColumn("target", F.concat(below, name))


def write_loose_files(converted: DataFrame, folder: str, root: str | None = None) -> None:
    """Converted lines as one text file each, in a folder all executors share.

    Files keep their place below ``root``, the folder they were read from. Each
    file's lines are sorted by Spark and streamed out, never gathered in memory.

    Written in two phases, in any store that Arrow knows. First each attempt of a task
    writes its files to a folder of its own below ``folder``; Spark commits the list of
    those of the attempts that count. Then the listed files are moved to their places,
    which may be done again. If the first phase fails, no file of ``folder`` has changed;
    the pending files are removed either way.
    """
    system, _, inner = file_system(folder)
    pending = f"{inner.rstrip('/')}/_pending-{uuid.uuid4().hex}"
    system.create_dir(pending, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, _ = file_system(folder)
        context = TaskContext.get()
        place = f"{pending}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(place)
        lines = ((t, x) for b in batches for t, x in zip(b["target"].to_pylist(), b["line"].to_pylist(), strict=True))
        for number, (target, group) in enumerate(itertools.groupby(lines, key=lambda pair: pair[0])):
            staged = f"{place}/{number}"
            with store.open_output_stream(staged, compression=None) as out:
                for at, (_, line) in enumerate(group):
                    out.write(("\n" if at else "").encode() + line.encode("utf-8"))
            yield pa.RecordBatch.from_pydict({"staged": [staged], "target": [target]})

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, _ = file_system(folder)
        for batch in batches:
            for staged, target in zip(batch["staged"].to_pylist(), batch["target"].to_pylist(), strict=True):
                publish_file(store, staged, f"{inner.rstrip('/')}/{target}")
            yield batch.select(["target"])

    order = [c for c in ("part", "line_no", "sub") if c in converted.columns]
    sorted_lines = (
        _with_target(converted, F.col("converted_path"), root).repartition("path")
        .sortWithinPartitions("path", *order).select("target", "line")
    )
    try:
        listed = materialize(sorted_lines.mapInArrow(write, "staged string, target string"), "staged")
        listed.mapInArrow(publish, "target string").count()
    finally:
        system.delete_dir(pending)


def publish_file(store: fs.FileSystem, staged: str, target: str) -> None:
    """Move a written file to its place; nothing is left to do if an earlier attempt has moved it."""
    there = store.get_file_info(staged).type == fs.FileType.File
    if there:
        store.create_dir(target.rpartition("/")[0], recursive=True)
        store.move(staged, target)
    elif store.get_file_info(target).type != fs.FileType.File:
        raise FileNotFoundError(f"neither written nor in place: {target}")


def write_notebooks(texts: DataFrame, folder: str, root: str | None = None) -> None:
    """Notebook texts (path, content) as ``.ipynb`` files, placed like loose files."""
    named = texts.select("path", F.lit(0).alias("line_no"), F.col("content").alias("line"),
                         base_name(F.col("path")).alias("filename"), F.lit("notebook").alias("file_type"))
    write_loose_files(named.withColumn("converted_path", converted_name()), folder, root)


@F.pandas_udf(T.StringType())
def _with_source(raw: pd.Series, source: pd.Series) -> pd.Series:
    """A cell's JSON with another source: text stays text, a list keeps its line ends."""
    def put(text: str, lines) -> str:
        cell = json.loads(text)
        ended = [line if line.endswith("\n") else line + "\n" for line in lines]
        if len(ended):
            ended[-1] = lines[-1]
        cell["source"] = "".join(ended) if isinstance(cell.get("source"), str) else ended
        return json.dumps(cell, ensure_ascii=False)

    return pd.Series([put(t, s) for t, s in zip(raw, source, strict=True)], dtype=object)


def notebook_json(cells: DataFrame, metadata: DataFrame) -> DataFrame:
    """Cells (path, cell_index, cell_type, source) and metadata to JSON texts.

    Cells that carry ``raw`` are kept whole, outputs and metadata included; where
    ``changed`` says so their source is replaced. The notebook's format number is
    taken from ``content`` if ``metadata`` has it. A notebook is one JSON value, so
    this gathers the cells of each notebook.
    """
    fields = F.to_json(F.struct("cell_type", "source"))
    cell = F.concat(F.lit('{"metadata": {}, '), fields.substr(F.lit(2), F.length(fields)))
    if "raw" in cells.columns:
        cells = cells.withColumn("changed", F.col("changed") if "changed" in cells.columns else F.lit(False))
        replaced = _with_source(F.coalesce("raw", F.lit("{}")), F.coalesce("source", strings([])))
        cells = cells.filter("changed and raw is not null").withColumn("raw", replaced).unionByName(
            cells.filter("not (changed and raw is not null)"))
        cell = F.coalesce(F.col("raw"), cell)
    texts = cells.groupBy("path").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("cell_index", cell.alias("cell")))), lambda c: c["cell"]),
            ", ",
        ).alias("_cells")
    )

    def entry(e: Column) -> Column:
        key = F.to_json(F.struct(e["key"].alias("k")))  # {"k":"..."}
        return F.concat(key.substr(F.lit(6), F.length(key) - 6), F.lit(": "), e["value"])

    entries = F.array_join(F.transform(F.map_entries("metadata"), entry), ", ")
    number = lambda key: F.coalesce(
        F.get_json_object("content", f"$.{key}") if "content" in metadata.columns else F.lit(None), F.lit("4"))
    return texts.join(metadata, "path").select(
        "path",
        F.concat(
            F.lit('{"cells": ['), "_cells", F.lit('], "metadata": {'), entries, F.lit('}, "nbformat": '), number("nbformat"),
            F.lit(', "nbformat_minor": '), number("nbformat_minor"), F.lit("}"),
        ).alias("content"),
    )
