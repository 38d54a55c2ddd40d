"""Totals kept by signed changes against counting everything again."""

import random

from pyspark.sql import functions as F

from lintmill.streaming.maintained import MaintainedTotals

SCHEMA = "file string, kind string, line int, dropped boolean"


def _batches(rng):
    """Batches of whole files: new, changed, unchanged, gone and back; null kinds and lines."""
    live, batches = {}, []
    for _ in range(5):
        rows = []
        for file in rng.sample("abcdefgh", 4):
            if rng.random() < 0.3:
                live[file] = []
                rows.append((file, None, None, True))
                continue
            live[file] = [(rng.choice(["x", "y", None]), rng.choice([None, *range(9)])) for _ in range(rng.randint(1, 3))]
            rows += [(file, kind, line, False) for kind, line in live[file]]
        batches.append((rows, {f: list(r) for f, r in live.items()}))
    return batches


def _expected(live, by):
    groups = {}
    for file, rows in live.items():
        for kind, line in rows:
            groups.setdefault(file if by == "file" else kind, []).append(line)
    found = set()
    for key, lines in groups.items():
        there = [v for v in lines if v is not None]
        found.add((key, len(lines), sum(v > 3 for v in there), min(there, default=None), max(there, default=None)))
    return found


def _kept(spark, folder, key):
    return MaintainedTotals(spark, folder, "file", [key], {"late": (F.col("line") > 3).cast("long")}, ["line"])


def _read(kept, key, before=None):
    return {tuple(r) for r in kept.read(before).select(key, "n", "late", "least_line", "greatest_line").collect()}


def test_same_as_counting_again(spark, tmp_path):
    batches = _batches(random.Random(11))
    for key in ("file", "kind"):
        kept = _kept(spark, str(tmp_path / key), key)
        for number, (rows, live) in enumerate(batches):
            kept.apply(spark.createDataFrame(rows, SCHEMA), number)
            assert _read(kept, key) == _expected(live, key)
        kept.apply(spark.createDataFrame(batches[-1][0], SCHEMA), len(batches) - 1)  # retried
        assert _read(kept, key) == _expected(batches[-1][1], key)
        assert _read(kept, key, before=2) == _expected(batches[1][1], key)


def test_from_a_stream(spark, tmp_path):
    source, kept = tmp_path / "in", _kept(spark, str(tmp_path / "kept"), "kind")
    source.mkdir()
    for number, (rows, live) in enumerate(_batches(random.Random(2))[:2]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / str(number)))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(source))
        kept.stream(stream, str(tmp_path / "checkpoint")).awaitTermination()
        assert _read(kept, "kind") == _expected(live, "kind")


def test_nothing_and_everything_gone(spark, tmp_path):
    kept = _kept(spark, str(tmp_path / "kept"), "kind")
    kept.apply(spark.createDataFrame([], SCHEMA), 0)
    assert kept.read().count() == 0
    kept.apply(spark.createDataFrame([("a", "x", 1, False)], SCHEMA), 1)
    kept.apply(spark.createDataFrame([("a", None, None, True), ("never", None, None, True)], SCHEMA), 2)
    assert kept.read().count() == 0 and _read(kept, "kind", before=2) == {("x", 1, 0, 1, 1)}
