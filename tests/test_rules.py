"""Rewrite rules, checks and scores on single values."""

import pytest
from pyspark.sql import functions as F

from lintmill.functions import checks, rewrite, scoring
from lintmill.functions.text import present
from lintmill.operators import advice
from lintmill.operators import findings as found
from lintmill.operators import validate

NAMING = "Table should use three-part naming"
CASES = [
    ("spark", 'df = spark.read.table("t1")', "", 'df = spark.read.table("main.default.t1")'),
    ("spark", "df = spark.read.table('t1')", "", "df = spark.read.table('t1')"),
    ("spark", 'a.saveAsTable("t") # spark.read.table("x.y")', "", 'a.saveAsTable("main.default.t") # spark.read.table("x.y")'),
    ("spark", 'spark.read.table("r"); a.saveAsTable("s")', "", 'spark.read.table("main.default.r"); a.saveAsTable("s")'),
    ("sql", "SELECT a FROM t JOIN u", "", "SELECT a FROM main.default.t JOIN u"),
    ("sql", "select a from  x.y, (select 1 from z)", "", "select a FROM main.default.x.y, (select 1 FROM main.default.z)"),
    ("sql", "CREATE TABLE IF NOT EXISTS t", "", "CREATE TABLE main.default.IF NOT EXISTS t"),
    ("sql", "DELETE FROM t", "", "DELETE FROM t"),
    ("sql", "SELECT a FROM été", "", "SELECT a FROM main.default.été"),
    ("imports", "import databricks.sql", "", "import databricks.sql\n# Note: Some databricks features may need UC updates"),
    ("databricks", "dbutils.fs.ls()", "", "# TODO: Review file path for Unity Catalog compatibility\ndbutils.fs.ls()"),
    ("general", "hive_metastore.a HIVE_METASTORE", "", "main.a HIVE_METASTORE"),
    ("general", "a Hive_Metastore", NAMING, "a Hive_Metastore"),
    ("general", "from a join b", NAMING, "FROM main.default.a join b"),
    ("general", "x.join(y); spark.table(\"from_t\")", NAMING, "x.join(y); spark.table('main.default.from_t')"),
    ("general", "FROM x.event_log", "", "FROM x.main.default.event_log"),
    ("general", "saveAsTable('analytics_summary')", "", "saveAsTable('main.default.analytics_summary')"),
    ("general", "f(spark.read.table('a'), spark.read.table(\"b\"), 'b')", "",
     "f(spark.read.table('main.default.a'), spark.read.table(\"main.default.b\"), 'main.default.b')"),
    ("general", "x.saveAsTable('s')", NAMING, "x.saveAsTable('main.default.s')"),
    ("other", "plain", NAMING, "plain"),
]


def _one(spark, line, category, message, **options):
    df = spark.createDataFrame([(line, category, message)], "l string, c string, m string")
    return df.select(rewrite.rewrite(F.col("l"), F.col("c"), F.col("m"), **options)).first()[0]


def test_rules(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, c string, l string, m string, want string")
    got = df.withColumn("got", rewrite.rewrite(F.col("l"), F.col("c"), F.col("m"))).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_safe_rules_change_nothing_twice(spark):
    df = spark.createDataFrame([c[:3] for c in CASES], "c string, l string, m string").filter("c in ('sql', 'spark')")
    once = df.withColumn("one", rewrite.rewrite(F.col("l"), F.col("c"), F.col("m"), "safe"))
    twice = once.withColumn("two", rewrite.rewrite(F.col("one"), F.col("c"), F.col("m"), "safe"))
    assert twice.filter("one <> two").count() == 0
    assert _one(spark, "SELECT a FROM x.y", "sql", "", rules="safe") == "SELECT a FROM x.y"
    assert _one(spark, "CREATE TABLE IF NOT EXISTS t", "sql", "", rules="safe") == "CREATE TABLE IF NOT EXISTS main.default.t"


def test_rules_of_ones_own(spark):
    mine = {"permissions": rewrite.named_table_rule([("secrets", "GRANT")])}
    assert _one(spark, "GRANT x ON secrets", "permissions", "", extra=mine) == "GRANT x ON main.default.secrets"
    assert _one(spark, "SELECT a FROM t", "sql", "", prefix="c$1.s\\.") == "SELECT a FROM c$1.s\\.t"


def test_checks(spark):
    code = "spark.sql('SELECT a FROM main.x, FROM dual FROM DUAL') spark.read.table(\"t\") Hive_Metastore (["
    df = spark.createDataFrame([(code, "df = read.table('a')", "df = read.table('a.b.c') + read.table('d.e.f')")], "c string, o string, m string")
    row = df.select(
        checks.compat_issues(F.col("c")), checks.syntax_issues(F.col("c")), checks.compat_warnings(F.lit("use x; dbutils.fs")),
        checks.logic_issues(F.col("o"), F.col("m")), checks.logic_issues(F.lit("select a"), F.lit("select a from b")),
        checks.parse_error(F.col("c")), checks.parse_error(F.col("m")),
    ).first()
    assert row[0] == [
        "Table 'main' should use three-part naming", "Table 'DUAL' should use three-part naming",
        "Table 't' should use catalog.schema.table format", "Direct hive_metastore references should be updated",
    ]
    assert row[1] == ["Mismatched parentheses", "Mismatched brackets"]
    assert row[2] == [
        "File system operations may need path updates for Unity Catalog", "USE database statements may need catalog prefix"]
    assert row[3] == ["Table reference count mismatch between original and modified code"]
    assert row[4] == ["SQL query structure may have been altered"]
    assert row[5].startswith("Syntax error: ") and row[6] is None


@pytest.mark.parametrize("cells, errors, warns, spark_, platform, score, level", [
    (0, 0, 3, False, False, 3, "low"), (6, 0, 3, False, False, 4, "medium"), (21, 2, 0, False, True, 8, "high"),
    (11, 0, 0, True, False, 4, "medium"),
])
def test_complexity(spark, cells, errors, warns, spark_, platform, score, level):
    value = scoring.complexity_score(F.lit(cells), F.lit(errors), F.lit(warns), F.lit(spark_), F.lit(platform))
    row = spark.range(1).select(value, scoring.complexity_class(value)).first()
    assert tuple(row) == (score, level)


def test_plan_values(spark):
    row = spark.range(1).select(
        scoring.effort_hours(F.lit("high"), F.lit(12), F.lit(3)), scoring.duration_days(F.lit("high"), F.lit(12)),
        scoring.duration_days(F.lit("low"), F.lit(6)), scoring.priority(F.lit("low"), F.lit(1)),
        F.size(scoring.risks(F.lit("high"), F.lit(11))), present(F.lit(None).cast("string"), F.lit("a")),
    ).first()
    assert tuple(row) == (30.6, 9, 2, "medium", 5, ["a"])


def test_counts_add_up(spark):
    from lintmill.catalog import queries
    from tests.conftest import SF

    findings = queries._findings(spark, SF)
    n = findings.count()
    for counts in (found.severity_counts(findings), found.category_counts(findings)):
        assert counts.agg(F.sum("findings")).first()[0] == n


def test_clean_file_passes(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    mods = spark.createDataFrame(
        [("b", 1, "x", "x)")], "file_path string, seq int, original_code string, modified_code string")
    out = validate.validations(files, validate.check(mods)).select("path", "validation_type", "is_valid", "issues_found")
    assert {tuple(r) for r in out.collect()} == {
        ("a", "syntax", True, 0), ("a", "compatibility", True, 0), ("a", "logic", True, 0),
        ("b", "syntax", False, 2), ("b", "compatibility", True, 0), ("b", "logic", True, 0),
    }


def test_missing_values_get_defaults(spark):
    df = spark.createDataFrame([("a", None, None)], "file_path string, line_number int, confidence_level double")
    row = found.with_defaults(df, found.MODIFICATION_DEFAULTS).first()
    assert (row.file_path, row.cell_index, row.line_number, row.change_type) == ("a", -1, 0, "replace")
    assert (row.confidence_level, row.requires_testing, row.breaking_change) == (0.8, True, False)


TEXT = """Intro
- not in a section
## 1. Preparation_Steps
1. Back up
  - check owners
2.
prose is skipped
Code review notes
- still there
CODE and other CHANGES
3.5- edit
TESTING
"""


def test_sections_of_a_text(spark):
    df = spark.createDataFrame([("d", TEXT)], "doc string, text string")
    out = advice.sections(advice.as_lines(df, "doc", "text"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.pos):
        got.setdefault(r.section, []).append(r.step)
    assert got["preparation_steps"] == ["Back up", "check owners", "still there"]
    assert got["code_changes"] == ["edit"]
    assert sorted(got["testing_steps"]) == [
        "Execute notebook in test environment", "Run integration tests", "Validate output and performance"]
    assert len(got["deployment_steps"]) == 3


def test_advice_lines(spark):
    text = "# heading\n- one\n\n \t\n--two --\n  # note\n3. three\nfour\nfive\nsix"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(advice.advice_lines(F.col("t"))).first()[0] == ["one", "two", "3. three", "four", "five"]
