"""Projections of the test tables onto the inputs the operators read.

Each view is SQL text that Spark and DuckDB both run; table names are filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One raw log line per event.
LINT = """
SELECT event_id AS seq,
  CASE WHEN event_id%97=0 THEN concat('# Total errors: ', CAST(event_id AS STRING)) ELSE concat(
    CASE WHEN event_id%13=0 THEN 'src/x' ELSE '' END,
    'job_', CAST(FLOOR(event_id/40) AS BIGINT), '_',
    CASE WHEN event_id%40<1 THEN 0 WHEN event_id%40<3 THEN 1 WHEN event_id%40<6 THEN 2
         WHEN event_id%40<10 THEN 3 WHEN event_id%40<16 THEN 4 WHEN event_id%40<25 THEN 5 ELSE 6 END,
    '.py:', event_id%6+1, ':',
    CASE WHEN event_id%11=0 THEN 'n/a' ELSE CAST(event_id%7 AS STRING) END, ': ',
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'error'
         WHEN 'click' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'note' END, ': ',
    CASE event_id%8 WHEN 0 THEN '[spark] spark.sql.warehouse.dir setting'
         WHEN 1 THEN '[sql] statement needs a catalog' WHEN 2 THEN '[imports] import needs review'
         WHEN 3 THEN '[databricks] path needs review: databricks'
         WHEN 4 THEN '[compatibility] Table reference should use three-part naming'
         WHEN 5 THEN '[compatibility] saveAsTable should use three-part naming'
         WHEN 6 THEN '[imports] databricks.sql module' ELSE '[compatibility] hive_metastore reference' END) END AS raw
FROM {events}
"""

# Findings in notebooks: 100 events to a notebook, at code lines 1 to 40.
NOTEBOOK_LINT = """
SELECT event_id AS seq, concat('nb_', CAST(FLOOR(event_id/100) AS BIGINT), '.ipynb:', event_id%40+1, ':1: ',
    CASE event_type WHEN 'click' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'error' END, ': ',
    CASE event_id%4 WHEN 0 THEN '[spark] spark setting' WHEN 1 THEN '[sql] statement needs a catalog'
         WHEN 2 THEN '[databricks] databricks path needs review'
         ELSE '[compatibility] Table reference should use three-part naming' END) AS raw
FROM {events}
"""

# One code line per order and line number. Duplicate line numbers of an order
# are summed, so numbering lines needs no ordering within an order.
CODE = """
SELECT filename, filename AS path, line_no,
CASE k%12
  WHEN 0 THEN concat('df = spark.read.table("t', s%9, '")')
  WHEN 1 THEN concat('df = spark.read.table(', chr(39), 't', s%9, chr(39), ')')
  WHEN 2 THEN concat('x.write.saveAsTable("t', s%9, '")')
  WHEN 3 THEN concat('spark.sql("SELECT a FROM t', s%9, '")')
  WHEN 4 THEN concat('    spark.sql("SELECT a FROM s.t', s%9, ' JOIN u")')
  WHEN 5 THEN concat('CREATE TABLE t', s%9, ' (a INT)')
  WHEN 6 THEN 'from pyspark.sql import SparkSession'
  WHEN 7 THEN 'import databricks.sql'
  WHEN 8 THEN concat('dbutils.fs.ls("/mnt/t', s%9, '")')
  WHEN 9 THEN concat('spark.sql("SELECT a FROM hive_metastore.s.t', s%9, '")')
  WHEN 10 THEN CASE s%3 WHEN 0 THEN '    JOIN user_profiles u' WHEN 1 THEN 'q = "FROM x.event_log JOIN event_log"'
       ELSE concat('f(spark.read.table("t', s%9, '"), spark.read.table(', chr(39), 'u', s%7, chr(39), '))') END
  ELSE 'b = SparkSession.builder.enableHiveSupport()' END AS line
FROM (
  SELECT CASE WHEN l_orderkey%8=7 THEN concat('b_',  CAST(FLOOR(l_orderkey/8) AS BIGINT), '_0.py')
     ELSE concat('job_', CAST(FLOOR(l_orderkey/8) AS BIGINT), '_', l_orderkey%8, '.py') END AS filename,
    CAST(l_linenumber AS INT) AS line_no,
    CAST(sum(l_partkey) AS BIGINT) AS k, CAST(sum(l_suppkey) AS BIGINT) AS s
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) g
"""

# One execute call per event, in four quote styles.
STMT = """
SELECT event_id AS seq, concat('etl_', CAST(FLOOR(event_id/5) AS BIGINT), '.py') AS file,
  concat('cur.execute(', q, CASE event_type WHEN 'purchase' THEN 'INSERT INTO' WHEN 'click' THEN 'UPDATE'
    WHEN 'error' THEN 'DELETE FROM' WHEN 'view' THEN 'SELECT x FROM' ELSE 'CREATE TABLE' END,
    ' main.s.t', event_id%20, ' -- ', event_type, q, ')') AS code
FROM (SELECT *, CASE event_id%4 WHEN 0 THEN '"' WHEN 1 THEN chr(39) WHEN 2 THEN '\"\"\"'
             ELSE concat(chr(39),chr(39),chr(39)) END AS q FROM {events}) e
"""

# One source file per document.
FILES = """
SELECT concat('src/', source, '/doc_', doc_id, '.py') AS path, concat('doc_', doc_id, '.py') AS filename,
  text AS content FROM {documents}
"""

# One advice text per conversation, as numbered lines.
ADVICE = """
SELECT conv_id AS doc, turn*2 AS pos,
  CASE turn%5 WHEN 0 THEN '1. PREPARATION_STEPS' WHEN 1 THEN '2. Code changes' WHEN 2 THEN '3. TESTING_STEPS'
       WHEN 3 THEN '4. DEPLOYMENT_STEPS' ELSE 'notes' END AS line
FROM {conversations} WHERE role <> 'system'
UNION ALL
SELECT conv_id, turn*2+1, CASE role WHEN 'assistant' THEN concat('- step ', turn)
  WHEN 'user' THEN concat(turn, '. item ', turn) ELSE 'plain text' END
FROM {conversations}
"""

# What the lines of notebook cells start with, by (conv_id + 3*turn + line) % 6.
CELL_CODE = """
CASE {key} WHEN 0 THEN 'df = spark.read.table("t1")' WHEN 1 THEN 'spark.sql("SELECT a FROM t2")'
  WHEN 2 THEN '  dbutils.fs.ls("/mnt")' WHEN 3 THEN 'q = "a FROM event_log"'
  WHEN 4 THEN 'b = SparkSession.builder.enableHiveSupport()' ELSE 'x = 1' END
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _view(spark: SparkSession, sf: str, text: str, name: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, sf, name)})


def _as_read(log: DataFrame) -> DataFrame:
    """The raw line as a stored value; else its making would be repeated in filters."""
    return log.select("seq", F.explode(F.array("raw")).alias("raw"))


def lint(spark, sf):
    return _as_read(_view(spark, sf, LINT, "events"))


def notebook_lint(spark, sf):
    return _as_read(_view(spark, sf, NOTEBOOK_LINT, "events"))


def code(spark, sf):
    return _view(spark, sf, CODE, "lineitem")


def statements(spark, sf):
    return _view(spark, sf, STMT, "events")


def files(spark, sf):
    return _view(spark, sf, FILES, "documents")


def advice(spark, sf):
    return _view(spark, sf, ADVICE, "conversations")


def cells(spark, sf):
    """Conversations as notebooks: one cell per turn, code where the assistant speaks."""
    key = "pmod(conv_id + 3 * turn + i, 6)"
    source = f"transform(split(text, '\\\\n'), (l, i) -> concat({CELL_CODE.format(key=key)}, '  # ', l))"
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("nb_"), "conv_id", F.lit(".ipynb")).alias("path"),
        F.col("turn").cast("int").alias("cell_index"),
        F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"),
        F.expr(source).alias("source"),
    )
