"""Readers and writers on small files."""

import json
import zipfile
from collections import Counter

from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions.text import clean_utf8, strip
from lintmill.operators import apply, lineage, reporting
from lintmill.operators import findings as found
from lintmill.plans.assessment import assess
from lintmill.sources import archives, readers, writers
from tests.conftest import rows


def test_python_files(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"# note\r\nx = 1\r\n\r\n  # more\ry = 2")
    (tmp_path / "bad.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "b.txt").write_text("x = 1")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.py").write_bytes(b"y\xff = '\xef\xbf\xbd'")
    files = readers.scan_python(spark, str(tmp_path))
    assert rows(files, "filename", "path", "line_count", "code_line_count", "file_type") == [
        ("a.py", str(tmp_path / "a.py"), 5, 2, "python")]
    assert files.first().lines == ["# note", "x = 1", "", "  # more", "y = 2"]
    assert rows(readers.file_lines(files), "line_no", "line")[1] == (2, "x = 1")
    tree = readers.scan_tree(spark, str(tmp_path))
    assert rows(tree, "filename", "content")[1:] == [("bad.py", "x = ''\n"), ("c.py", "y = '�'")]


def test_display_caps(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"{n}.py").write_text("\n".join(f"line {i}" for i in range(30)))
    assert [r.path[-4:] for r in readers.entries(spark, str(tmp_path), 3).collect()] == ["0.py", "1.py", "2.py"]
    assert readers.entries(spark, str(tmp_path / "gone")).count() == 0
    shown = readers.preview(readers.scan_python(spark, str(tmp_path))).first().preview
    assert shown.split("\n") == [f"line {i}" for i in range(20)]
    errors = spark.createDataFrame([(s, f"e{s}") for s in range(9)], "seq int, message string")
    assert [r.message for r in reporting.first_errors(errors).collect()] == ["e0", "e1", "e2"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("　\x1f a b \x85\n",)], "t string")
    assert df.select(strip(F.col("t"))).first()[0] == "a b"
    raw = spark.createDataFrame([(bytearray(b"a\xc3(\xe2\x82\xac\xf0\x9f"),)], "b binary")
    assert raw.select(clean_utf8(F.col("b"))).first()[0] == b"a\xc3(\xe2\x82\xac\xf0\x9f".decode("utf-8", "ignore")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("p/a.py", "x = 1\n")
        z.writestr("p/readme.md", "no")
        z.writestr("b.py", b"\xffy")
    files = readers.scan_archive(spark, str(tmp_path))
    assert rows(files, "filename", "content") == [("a.py", "x = 1\n"), ("b.py", "y")]
    assert rows(files, "path")[0] == (f"{tmp_path}/one.zip!/b.py",)


def test_one_archive_goes_to_many_tasks(spark, tmp_path):
    files = [(f"p/{i}.py", "".join(f"line {i} {j}\n" for j in range(i % 40))) for i in range(1000)]
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files:
            z.writestr(name, text)
    listed = spark.createDataFrame([(f"{tmp_path}/big.zip",)], "path string")
    found = archives.members(listed, ".py", part_bytes=4096)
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.path.split("!/")[1], bytes(r.content).decode()) for r in got) == sorted(files)
    per_task = Counter(r.task for r in got)
    assert len(per_task) >= 4 and max(per_task.values()) < 500
    assert len({r.path for r in got}) == 1000 and {r.reason for r in got} == {None}


def test_odd_members_are_rows_with_a_reason(spark, tmp_path):
    path = tmp_path / "odd.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("good.py", "x = 1")
        z.writestr("bad.py", "spoilt = 1" * 50)
        z.writestr("squeezed.py", "y = 2", compress_type=zipfile.ZIP_BZIP2)
        z.writestr("rare.py", "z = 3", compress_type=zipfile.ZIP_LZMA)
        z.writestr("empty.py", "")
        z.writestr("folder/", "")
    raw = path.read_bytes()
    path.write_bytes(b"before" + raw.replace(b"spoilt = 1" * 50, b"spoilt = 2" * 50, 1))
    (tmp_path / "none.zip").write_bytes(b"no archive")
    (tmp_path / "void.zip").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "nothing.zip", "w"):
        pass
    scanned = readers.scan_archive(spark, str(tmp_path))
    assert rows(scanned, "filename", "content") == [("empty.py", ""), ("good.py", "x = 1"), ("squeezed.py", "y = 2")]
    skipped = {r.path.rpartition("/")[2]: r.reason for r in readers.skipped_inputs(spark, str(tmp_path)).collect()}
    assert set(skipped) == {"bad.py", "rare.py", "none.zip", "void.zip"}
    assert "checksum" in skipped["bad.py"] and "method 14" in skipped["rare.py"]
    assert readers.scan_archive(spark, str(tmp_path / "gone")).count() == 0


def test_packed_archives_hold_every_file_once(spark, tmp_path):
    files = spark.range(25).select(
        F.concat(F.lit("d/"), "id", F.lit(".py")).alias("path"), F.when(F.col("id") > 0, F.concat(F.lit("é"), "id")).alias("content"))
    for _ in range(2):  # again into the same folder
        archives.pack(files.coalesce(1), str(tmp_path / "out"), per_archive=10)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"000000-00000{i}.zip" for i in range(3)]
    back = readers.scan_archive(spark, str(tmp_path / "out"))
    assert rows(back.select(F.substring_index("path", "!/", -1).alias("p"), "content")) == sorted(
        (f"d/{i}.py", f"é{i}" if i else "") for i in range(25))


NOTEBOOK = {
    "cells": [
        {"cell_type": "code", "source": ["# first\n", "df = spark.table('a.b')\n", "df.show()"], "outputs": []},
        {"cell_type": "markdown", "source": "text"},
        {"cell_type": "code", "source": "x = 1\ny = [2]"},
        {"cell_type": "code", "source": '["a", "b"]'},
        {"cell_type": "code"},
    ],
    "metadata": {"kernelspec": {"name": "python3"}, "odd \"key\"": 3},
}


def test_notebooks(spark, tmp_path):
    (tmp_path / "n.ipynb").write_text(json.dumps(NOTEBOOK, indent=1))
    (tmp_path / "broken.ipynb").write_text("{not json")
    books = readers.scan_notebooks(spark, str(tmp_path))
    assert rows(books, "filename", "cell_count", "code_cell_count", "file_type") == [("n.ipynb", 5, 4, "notebook")]
    cells = readers.notebook_cells(books)
    assert [r.source for r in cells.orderBy("cell_index").collect()] == [
        ["# first\n", "df = spark.table('a.b')\n", "df.show()"], ["text"], ["x = 1", "y = [2]"], ['["a", "b"]'], [],
    ]
    meta = books.select("path", apply.converted_metadata(F.col("metadata")).alias("metadata"))
    text = writers.notebook_json(cells, meta).first().content
    back = json.loads(text)
    assert [c["cell_type"] for c in back["cells"]] == ["code", "markdown", "code", "code", "code"]
    assert back["cells"] == NOTEBOOK["cells"] and back["nbformat"] == 4
    assert back["metadata"]["kernelspec"] == {"name": "python3"} and back["metadata"]['odd "key"'] == 3
    assert back["metadata"]["unity_catalog_converted"] is True


LOG = """src/etl.py:2:1: error: [compatibility] Table reference 't' should use three-part naming

src/etl.py:x:9: warning: [sql] needs: a catalog
# Total errors: 2
note without a word: 1: 2: 3
etl.py:99999999999:1: plain message about sparkling information
other.py:1:1: WARNING and Error
"""


def test_changed_cells_keep_the_rest(spark, tmp_path):
    cells = [
        {"cell_type": "code", "source": ["a\n", "b"], "outputs": [{"x": 1}], "execution_count": 3, "metadata": {"k": []}},
        {"cell_type": "code", "source": "a\nb", "outputs": [], "metadata": {}},
        {"cell_type": "markdown", "source": "a\nb", "metadata": {}},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_n.ipynb").write_text(json.dumps({"cells": cells, "metadata": {}, "nbformat": 4, "nbformat_minor": 5}))
    books = readers.scan_notebooks(spark, str(tmp_path / "in"))
    path = str(tmp_path / "in" / "_n.ipynb")
    applied = spark.createDataFrame(
        [(path, c, n, line, n == 0) for c in (0, 1) for n, line in enumerate(["new", "b"])],
        "path string, cell_index int, line_no int, line string, applied boolean")
    done = apply.converted_cells(readers.notebook_cells(books), applied)
    writers.write_notebooks(writers.notebook_json(done, books.select("path", "metadata", "content")), str(tmp_path / "out"))
    back = json.loads((tmp_path / "out" / "_n_unity_catalog.ipynb").read_text())
    assert back["cells"][1:] == [{**cells[0], "source": ["new\n", "b"]}, {**cells[1], "source": "new\nb"}, cells[2]]
    assert back["nbformat_minor"] == 5 and back["cells"][0]["cell_type"] == "markdown"


def test_no_name_is_hidden(spark, tmp_path):
    for name in ("a/utils.py", "a/__init__.py", "a/.h.py", "_lib/z.py", "b/utils.py"):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(f"# {name}\nx = 1")
    tree = readers.scan_tree(spark, str(tmp_path / "src"))
    assert sorted(r.path[len(str(tmp_path)) + 5:] for r in tree.collect()) == [
        "_lib/z.py", "a/.h.py", "a/__init__.py", "a/utils.py", "b/utils.py"]
    assert readers.scan_python(spark, str(tmp_path / "src" / "a")).count() == 3

    (tmp_path / "logs").mkdir()
    for name in ("_a.txt", "b.txt"):
        (tmp_path / "logs" / name).write_text(f"{name}.py:1:2: error: one\n{name}.py:2:2: error: two\n")
    found = readers.scan_lint(spark, str(tmp_path / "logs"))
    assert [(r.file_path, r.line_number) for r in found.orderBy("seq").collect()] == [
        ("_a.txt.py", 1), ("_a.txt.py", 2), ("b.txt.py", 1), ("b.txt.py", 2)]
    assert readers.scan_lint(spark, str(tmp_path / "logs" / "_a.txt")).count() == 2

    lines = readers.file_lines(tree).withColumn("applied", F.lit(True))
    writers.write_loose_files(apply.converted_lines(tree, lines), str(tmp_path / "out"))
    for name in ("a/utils", "b/utils"):
        text = (tmp_path / "out" / f"{name}_unity_catalog.py").read_text().split("\n")
        assert text == [*V.PYTHON_HEADER, f"# {name}.py", "x = 1"]


def test_skipped_inputs(spark, tmp_path):
    (tmp_path / "bad.py").write_bytes(b"\xff")
    (tmp_path / "good.py").write_text("x")
    (tmp_path / "bad.ipynb").write_text("{not json")
    (tmp_path / "bad.zip").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a.py", "x")
    skipped = {r.path.split("/")[-1]: r.reason for r in readers.skipped_inputs(spark, str(tmp_path)).collect()}
    assert skipped.keys() == {"bad.py", "bad.ipynb", "bad.zip"} and skipped["bad.ipynb"] == "not a notebook"
    assert rows(readers.scan_archive(spark, str(tmp_path)), "filename") == [("a.py",)]


def test_lint_log(spark, tmp_path):
    (tmp_path / "lint.txt").write_text(LOG)
    findings = readers.scan_lint(spark, str(tmp_path / "lint.txt"))
    got = [tuple(r) for r in findings.orderBy("seq").select(
        "file_path", "line_number", "column_number", "severity", "category", "tag", "message").collect()]
    assert got == [
        ("src/etl.py", 2, 1, "error", "general", "compatibility",
         "error: [compatibility] Table reference 't' should use three-part naming"),
        ("src/etl.py", 0, 9, "warning", "sql", "sql", "warning: [sql] needs: a catalog"),
        ("etl.py", 0, 1, "info", "spark", "", "plain message about sparkling information"),
        ("other.py", 1, 1, "error", "general", "", "WARNING and Error"),
    ]
    nested = found.findings_arrays(findings, 1)
    assert nested.count() == 4
    assert found.findings_arrays(findings, 10).filter("size(findings) = 2").count() == 1
    maps = found.as_map(found.severity_counts(findings), "severity")
    assert maps.filter("file_path = 'src/etl.py'").first().by_severity == {"error": 1, "warning": 1}


def test_missing_inputs(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert readers.scan_python(spark, gone).count() == 0
    assert readers.scan_notebooks(spark, gone).columns[0] == "filename"
    assert readers.scan_lint(spark, gone).count() == 0
    checks = {r.check: r.ok for r in readers.preflight(spark, gone, gone).collect()}
    assert checks == {"folder": False, "files": False, "log": False}
    (tmp_path / "lint.txt").write_text("x")
    checks = {r.check: r.ok for r in readers.preflight(spark, str(tmp_path), str(tmp_path / "lint.txt")).collect()}
    assert checks == {"folder": True, "files": False, "log": True}
    (tmp_path / "__init__.py").write_text("x")
    (tmp_path / "_a.txt").write_text("x")
    checks = {r.check: r.ok for r in readers.preflight(spark, str(tmp_path), str(tmp_path / "_a.txt")).collect()}
    assert checks == {"folder": True, "files": True, "log": True}


def test_whole_run_from_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "etl.py").write_text("import os\nq = spark.sql('SELECT a FROM t')\nb = SparkSession.builder.enableHiveSupport()\n")
    (src / "other.py").write_text("x = 1\n")
    (tmp_path / "lint.txt").write_text(LOG)
    files = readers.with_cell_counts(readers.scan_python(spark, str(src)))
    lines = readers.file_lines(files)
    run = assess(readers.scan_lint(spark, str(tmp_path / "lint.txt")), files, lines)
    mods = run.modifications.orderBy("seq").collect()
    assert [(m.line_number, m.modified_code, m.confidence_level) for m in mods] == [
        (1, "q = spark.sql('SELECT a FROM main.default.t')", 0.9),
        (2, 'b = SparkSession.builder.config("spark.sql.catalog.spark_catalog", "unity")', 0.9),
    ]
    report = {r.filename: r for r in run.file_report.collect()}
    assert report["etl.py"].findings == 3 and report["etl.py"].modifications_status == "completed"
    assert report["other.py"].modifications_status == "no_modifications_needed"
    assert report["etl.py"].overall_status == "failed"  # the qualified name is flagged again

    writers.write_json(run.tables(), str(tmp_path / "out"))
    written = spark.read.json(str(tmp_path / "out" / "run_summary")).first()
    assert (written.total_files, written.code_modifications, written.success) == (2, 2, True)

    applied = apply.apply_at_position(lines, run.modifications)
    converted = apply.converted_lines(run.files, applied)
    writers.write_loose_files(converted, str(tmp_path / "conv"))
    text = (tmp_path / "conv" / "etl_unity_catalog.py").read_text().split("\n")
    header = len(V.PYTHON_HEADER)
    assert len(text) == header + 4 and text[header] == "import os" and "main.default.t" in text[header + 1]
    assert [p.name for p in (tmp_path / "conv").iterdir()] == ["etl_unity_catalog.py"]


def test_lineage_from_code(spark):
    code = [
        ("a.py", 'c.execute("""\nINSERT  INTO `main`.s.t VALUES (1)\n""")\nc.execute( f\'update [x] set a=1\' )'),
        ("b.py", "c.EXECUTE(rb\"DELETE\nFROM \\\"q\\\" -- UPDATE y\")\nc.execute('SELECT 1')"),
        ("c.py", "executemany('INSERT INTO z VALUES (1)')"),
    ]
    got = rows(lineage.edges(spark.createDataFrame(code, "file string, code string")), "file", "operation", "table")
    # A quote inside a literal ends it (the pattern knows no escapes), so b.py has no table name.
    assert got == [("a.py", "INSERT  INTO", "main`.s.t"), ("a.py", "UPDATE", "x")]
