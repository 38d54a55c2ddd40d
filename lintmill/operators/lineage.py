"""Write lineage from SQL strings in code: file, operation, table, preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions.classify import first_hit
from lintmill.functions.text import strip_chars, swap


def statements(code: DataFrame) -> DataFrame:
    """SQL texts given to ``execute`` calls: (file, statement)."""
    found = F.regexp_extract_all("code", F.lit(V.EXECUTE_PATTERN), 3)
    return code.select(*[c for c in code.columns if c != "code"], F.explode(found).alias("statement"))


def preview(statement: Column) -> Column:
    return swap(F.substring(statement, 1, V.PREVIEW_CHARS), "\n", " ")


def edges(code: DataFrame) -> DataFrame:
    """One row per write operation found in the statements."""
    found = F.arrays_zip(
        F.regexp_extract_all("statement", F.lit(V.WRITE_PATTERN), 1).alias("operation"),
        F.regexp_extract_all("statement", F.lit(V.WRITE_PATTERN), 2).alias("target"),
    )
    return (
        statements(code).withColumn("_write", F.explode(found))
        .select(
            "file", F.upper("_write.operation").alias("operation"),
            strip_chars(F.col("_write.target"), V.TABLE_QUOTES).alias("table"),
            preview(F.col("statement")).alias("preview"),
        )
    )


def choose(lineage: DataFrame, file: str | None = None, table: str | None = None) -> DataFrame:
    """Keep the rows of one file and/or one table; None keeps all."""
    for name, wanted in (("file", file), ("table", table)):
        if wanted is not None:
            lineage = lineage.filter(F.col(name) == wanted)
    return lineage


def listing(lineage: DataFrame) -> DataFrame:
    """Sorted by file, table and operation; equal rows may span several tasks."""
    return (
        lineage.select("file", "operation", "table", "preview")
        .withColumn("_tie", F.monotonically_increasing_id())
        .orderBy("file", "table", "operation", "_tie").drop("_tie")
    )


def options(lineage: DataFrame) -> DataFrame:
    """Distinct files and tables to choose from, sorted: (kind, id)."""
    return _ends(lineage).orderBy("kind", "id")


def _ends(lineage: DataFrame) -> DataFrame:
    return lineage.select(F.explode(F.array(
        F.struct(F.lit("file").alias("kind"), F.col("file").alias("id")),
        F.struct(F.lit("table").alias("kind"), F.col("table").alias("id")),
    )).alias("_o")).select("_o.*").distinct()


def nodes(lineage: DataFrame) -> DataFrame:
    color = F.when(F.col("kind") == "file", V.FILE_NODE_COLOR).otherwise(V.TABLE_NODE_COLOR)
    return _ends(lineage).withColumn("color", color)


def graph_edges(lineage: DataFrame) -> DataFrame:
    cases = [(F.col("operation") == op, color) for op, color in V.OPERATION_COLORS.items()]
    return lineage.select(
        F.col("file").alias("src"), F.col("table").alias("dst"), F.col("operation").alias("label"),
        first_hit(cases, V.DEFAULT_EDGE_COLOR).alias("color"),
    )


def counts(lineage: DataFrame) -> DataFrame:
    return lineage.agg(
        F.count(F.lit(1)).alias("write_statements"),
        F.count_distinct("file").alias("files"), F.count_distinct("table").alias("tables"),
    )
