"""Matching against brute force."""

import random

from pyspark.sql import functions as F

from lintmill.operators import matching
from lintmill.operators.findings import parse_findings
from lintmill.plans.assessment import assess
from tests.conftest import rows


def test_containment(spark):
    rng = random.Random(5)
    names = ["a", "ab", "abc", "order.py", "reorder.py", "é.py", "x y.py", "bb"] + [
        "".join(rng.choice("abc.") for _ in range(rng.randint(1, 6))) for _ in range(60)
    ]
    paths = ["", "a", "src/reorder.py", "src/é.py", "deep/x y.py"] + [
        "".join(rng.choice("abc./") for _ in range(rng.randint(1, 25))) for _ in range(200)
    ]
    left = spark.createDataFrame([(p,) for p in paths], "file_path string")
    right = spark.createDataFrame([(n,) for n in names], "filename string")
    expected = sorted((p, n) for p in set(paths) for n in set(names) if n in p)
    assert rows(matching.match_contains(left, right), "file_path", "filename") == expected


def test_basename(spark):
    left = spark.createDataFrame([("src/order.py",), ("reorder.py",), ("order.py",)], "file_path string")
    right = spark.createDataFrame([("order.py",), ("other.py",)], "filename string")
    assert rows(matching.match_basename(left, right)) == [("order.py", "order.py"), ("src/order.py", "order.py")]


def test_path(spark):
    left = spark.createDataFrame(
        [("./a/utils.py",), ("/repo/b/utils.py",), ("utils.py",), ("xutils.py",), ("c/utils.py",), ("",), ("a/",)], "file_path string")
    right = spark.createDataFrame([("a/utils.py",), ("b/utils.py",), ("deep/a/utils.py",), ("main.py",), ("",)], "path string")
    assert rows(matching.match_path(left, right)) == [
        ("./a/utils.py", "a/utils.py"), ("/repo/b/utils.py", "b/utils.py"),
        ("utils.py", "a/utils.py"), ("utils.py", "b/utils.py"), ("utils.py", "deep/a/utils.py"),
    ]


def test_run_by_path(spark):
    """Findings of one of two files of a name stay with it."""
    files = spark.createDataFrame(
        [(p, "utils.py", "python", 0, 0) for p in ("a/utils.py", "b/utils.py")],
        "path string, filename string, file_type string, cell_count int, code_cell_count int")
    lines = spark.createDataFrame([(p, 1, 'spark.read.table("t")') for p in ("a/utils.py", "b/utils.py")],
                                  "path string, line_no int, line string")
    log = spark.createDataFrame([(1, "src/a/utils.py:1:1: error: [spark] spark table")], "seq long, raw string")
    found = parse_findings(log)
    count = lambda match: rows(assess(found, files, lines, match=match, parse=False).analysis, "path", "findings")
    assert count("path") == [("a/utils.py", 1), ("b/utils.py", 0)]
    assert count("contains") == [("a/utils.py", 1), ("b/utils.py", 1)]


def test_first_matching_line(spark):
    rng = random.Random(7)
    lines = [
        (f"f{f}", n, rng.choice(["", "  "]) + "".join(rng.choice("ab ") for _ in range(rng.randint(0, 8))))
        for f in range(5) for n in range(1, 30)
    ]
    mods = [
        (s, f"f{rng.randint(0, 5)}", "".join(rng.choice("ab ") for _ in range(rng.randint(0, 5))))
        for s in range(150)
    ]
    out = matching.first_matching_line(
        spark.createDataFrame(lines, "path string, line_no int, line string"),
        spark.createDataFrame(mods, "seq long, path string, original_code string"),
    )
    expected = []
    for seq, path, code in mods:
        hits = [n for p, n, text in lines if p == path and code.strip() in text.strip()]
        if hits:
            expected.append((seq, min(hits)))
    assert rows(out, "seq", "first_line") == sorted(expected)


def _cells(spark):
    rng = random.Random(11)
    cells = [
        (f"n{b}.ipynb", c, rng.choice(["code", "code", "markdown"]),
         [f"l{c}.{i}" for i in range(rng.choice([0, 1, 3, 90, 200]))])
        for b in range(3) for c in range(12)
    ]
    return cells, spark.createDataFrame(cells, "path string, cell_index int, cell_type string, source array<string>")


def test_cells(spark):
    cells, df = _cells(spark)
    where = {}
    for path in {c[0] for c in cells}:
        at = 0
        for _, index, kind, source in sorted(c for c in cells if c[0] == path):
            if kind == "code":
                for i, _ in enumerate(source):
                    at += 1
                    where[path, at] = (index, i)
    spots = spark.createDataFrame(
        [(p, p, n) for p in {c[0] for c in cells} for n in range(0, 1200, 3)],
        "file_path string, path string, line_number int",
    )
    out = matching.spot_cells(spots, matching.cell_spans(df))
    got = {(r.path, r.line_number): (r.cell_index, r.cell_line) for r in out.collect()}
    assert got == {k: v for k, v in where.items() if k[1] % 3 == 0}
    source = matching.notebook_source(df)
    assert {(r.path, r.line_number): (r.cell_index, r.place) for r in source.collect()} == where


def test_files_that_share_a_name(spark):
    findings = spark.createDataFrame(
        [(1, "x/__init__.py", 1, "error", "spark", "m"), (2, "__init__.py", 2, "warning", "sql", "databricks")],
        "seq long, file_path string, line_number int, severity string, category string, message string",
    )
    files = spark.createDataFrame(
        [("p/__init__.py", "__init__.py"), ("q/__init__.py", "__init__.py"), ("z.py", "z.py")],
        "path string, filename string",
    )
    from lintmill.operators.findings import finding_totals

    pairs = matching.match_contains(findings, files)
    totals = matching.totals_per_file(finding_totals(findings), pairs, files)
    assert rows(totals, "path", "findings", "errors", "any_platform") == [
        ("p/__init__.py", 2, 1, True), ("q/__init__.py", 2, 1, True)]
    spots = matching.spots(findings)
    assert rows(matching.spot_files(spots, pairs, files), "path", "line_number") == [
        ("p/__init__.py", 1), ("p/__init__.py", 2), ("q/__init__.py", 1), ("q/__init__.py", 2)]


def test_spots_and_files_hot_on_both_sides(spark):
    """One path of many findings and spots means many files: split as finely as can be, nothing is lost."""
    findings = spark.range(240).select(
        F.col("id").alias("seq"), F.when(F.col("id") < 180, "x/u.py").otherwise("y.py").alias("file_path"),
        (F.col("id") % 30).cast("int").alias("line_number"))
    files = spark.range(40).select(
        F.concat(F.lit("d"), "id").alias("path"), F.when(F.col("id") < 30, "u.py").otherwise("y.py").alias("filename"))
    source = files.crossJoin(spark.range(25)).select(
        "path", F.col("id").cast("int").alias("line_number"), F.concat("path", F.lit(" "), "id").alias("line"))
    pairs = matching.match_contains(findings, files)
    whole = rows(matching.finding_lines(findings, pairs, files, source), "seq", "path", "line")
    assert len(whole) == 150 * 30 + 50 * 10
    assert rows(matching.finding_lines(findings, pairs, files, source, hot_rows=4), "seq", "path", "line") == whole


def test_a_run_works_out_its_lines_and_spots_once(spark, monkeypatch):
    """A query reads its lines back; spots are stored, and validation rows only where they are read again."""
    from lintmill.catalog import queries
    from lintmill.plans import assessment
    from tests.conftest import SF

    kinds = []
    for module in (queries, matching, assessment):
        stored = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, kind, stored=stored: kinds.append(kind) or stored(df, kind))
    run = queries._python_run(spark, SF)
    run.modifications
    assert "Aggregate" not in run.source._jdf.queryExecution().optimizedPlan().toString()
    assert kinds.count("lines") == kinds.count("spots") == 1
    queries.validation_summary(spark, SF).collect()
    assert "validations" not in kinds
