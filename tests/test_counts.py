"""Known counts on the test tables, worked out separately."""

from pyspark.sql import functions as F

from lintmill.catalog import queries, views
from lintmill.functions.rewrite import rewrite
from lintmill.functions.text import strip
from lintmill.operators import matching
from lintmill.plans.assessment import python_files
from tests.conftest import rows

SF = "/root/testdata/sf0.01"

# One line per lineitem, numbered within the order.
LINES = """
SELECT CASE WHEN l_orderkey%8=7 THEN concat('b_',  CAST(FLOOR(l_orderkey/8) AS BIGINT), '_0.py')
     ELSE concat('job_', CAST(FLOOR(l_orderkey/8) AS BIGINT), '_', l_orderkey%8, '.py') END AS path,
CAST(row_number() OVER (PARTITION BY l_orderkey
     ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_no,
CASE l_partkey%12
  WHEN 0 THEN concat('df = spark.read.table("t', l_suppkey%9, '")')
  WHEN 1 THEN concat('df = spark.read.table(', chr(39), 't', l_suppkey%9, chr(39), ')')
  WHEN 2 THEN concat('x.write.saveAsTable("t', l_suppkey%9, '")')
  WHEN 3 THEN concat('spark.sql("SELECT a FROM t', l_suppkey%9, '")')
  WHEN 4 THEN concat('    spark.sql("SELECT a FROM s.t', l_suppkey%9, ' JOIN u")')
  WHEN 5 THEN concat('CREATE TABLE t', l_suppkey%9, ' (a INT)')
  WHEN 6 THEN 'from pyspark.sql import SparkSession'
  WHEN 7 THEN 'import databricks.sql'
  WHEN 8 THEN concat('dbutils.fs.ls("/mnt/t', l_suppkey%9, '")')
  WHEN 9 THEN concat('spark.sql("SELECT a FROM hive_metastore.s.t', l_suppkey%9, '")')
  WHEN 10 THEN '    JOIN user_profiles u'
  ELSE 'b = SparkSession.builder.enableHiveSupport()' END AS line
FROM {lineitem}
"""


def test_complexity_classes(spark):
    assert rows(queries.QUERIES["complexity_dist"](spark, SF)) == [("high", 624), ("low", 1039), ("medium", 567)]


def test_errors_by_category(spark):
    errors = queries._findings(spark, SF).filter("severity = 'error'")
    assert rows(errors.groupBy("category").count()) == [
        ("databricks", 506), ("general", 1465), ("imports", 497), ("spark", 492), ("sql", 991),
    ]


def test_rewrites_by_category(spark):
    lines = spark.sql(LINES, lineitem=views.table(spark, SF, "lineitem"))
    files, findings = python_files(lines), queries._findings(spark, SF)
    pairs = matching.match_contains(findings, files)
    assert pairs.count() == 2358
    found = matching.finding_lines(findings, pairs, files, matching.python_source(lines))
    clean = strip(F.col("line"))
    new = found.withColumn("new", rewrite(clean, F.col("category"), F.col("message"))).withColumn("clean", clean)
    counted = new.groupBy("category").agg(
        F.count(F.lit(1)), F.count_if(F.col("new") != F.col("line")),
        F.count_if((F.col("new") != F.col("line")) & (F.col("new") == F.col("clean"))),
        F.count_distinct("new"),
    )
    assert rows(counted) == [
        ("databricks", 549, 129, 87, 76), ("general", 1762, 1083, 44, 95), ("imports", 679, 203, 96, 76),
        ("spark", 843, 284, 150, 76), ("sql", 1227, 508, 90, 76),
    ]


def test_lineage_operations(spark):
    edges = queries.QUERIES["lineage_edges"](spark, SF)
    assert rows(edges.groupBy("operation").count()) == [("DELETE FROM", 2014), ("INSERT INTO", 1981), ("UPDATE", 2006)]
    assert edges.select("table").distinct().count() == 20


def test_section_steps(spark):
    steps = queries.QUERIES["section_parse"](spark, SF).filter("pos >= 0")
    counted = steps.groupBy("section").agg(F.count(F.lit(1)), F.count_distinct("doc"))
    assert rows(counted) == [
        ("code_changes", 130, 100), ("deployment_steps", 144, 78),
        ("preparation_steps", 127, 91), ("testing_steps", 111, 92),
    ]
