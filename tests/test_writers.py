"""Converted files appear all together, or not at all."""

import pytest
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lintmill.sources import writers


def _converted(spark, files, line):
    return spark.range(files * 3).select(
        F.concat(F.lit("src/"), F.col("id") % files, F.lit(".py")).alias("path"),
        F.concat(F.lit("out_"), F.col("id") % files, F.lit(".py")).alias("converted_path"),
        F.floor(F.col("id") / files).cast("int").alias("line_no"), line.alias("line"))


def _read(folder):
    return {str(p.relative_to(folder)): p.read_text(encoding="utf-8") for p in folder.rglob("*") if p.is_file()}


def test_files_are_whole_and_nothing_is_left_over(spark, tmp_path):
    (tmp_path / "other.txt").write_text("kept")
    line = F.concat(F.lit("é "), F.col("id"))
    for _ in range(2):  # again over the same files
        writers.write_loose_files(_converted(spark, 20, line), str(tmp_path), "src")
    expected = {f"out_{i}.py": f"é {i}\né {i + 20}\né {i + 40}" for i in range(20)}
    assert _read(tmp_path) == {**expected, "other.txt": "kept"}
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]


def test_a_failed_run_changes_nothing(spark, tmp_path):
    good, bad = F.lit("new"), F.when(F.col("id") == 40, F.raise_error(F.lit("stop"))).otherwise("new")
    (tmp_path / "out_0.py").write_text("old")
    with pytest.raises(PySparkException):
        writers.write_loose_files(_converted(spark, 20, bad), str(tmp_path), "src")
    assert _read(tmp_path) == {"out_0.py": "old"}
    writers.write_loose_files(_converted(spark, 20, good).limit(0), str(tmp_path), "src")
    assert _read(tmp_path) == {"out_0.py": "old"} and len(list(tmp_path.iterdir())) == 1


def test_publishing_may_be_repeated(tmp_path):
    store = fs.LocalFileSystem()
    (tmp_path / "staged").write_text("x")
    target = str(tmp_path / "a" / "b.py")
    for _ in range(2):
        writers.publish_file(store, str(tmp_path / "staged"), target)
    assert (tmp_path / "a" / "b.py").read_text() == "x"
    with pytest.raises(FileNotFoundError):
        writers.publish_file(store, str(tmp_path / "staged"), str(tmp_path / "never.py"))
