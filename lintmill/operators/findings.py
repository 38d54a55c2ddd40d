"""Findings: parse log lines, count, analyse and summarise them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions import classify, scoring
from lintmill.functions.text import has, strip
from lintmill.operators.skew import first_rows, running_total


def admitted(raw: Column) -> Column:
    """A log line counts if it holds a colon and, anywhere, a severity word."""
    text = F.lower(raw)
    word = has(text, V.SEVERITY_WORDS[0])
    for w in V.SEVERITY_WORDS[1:]:
        word = word | has(text, w)
    return has(raw, ":") & word


def _number(part: Column) -> Column:
    text = strip(part)
    number = F.when(text.rlike(r"^[0-9]+\z"), text.try_cast("int"))
    return F.coalesce(number, F.lit(0))


def parse_findings(log: DataFrame, raw: str = "raw") -> DataFrame:
    """Log lines ``(seq, raw)`` to findings; other lines are left out."""
    parts = F.split(F.col(raw), ":", -1)
    message = strip(F.array_join(F.slice(F.col("_parts"), 4, F.size("_parts")), ":"))
    return (
        log.filter(admitted(F.col(raw)))
        .select("seq", parts.alias("_parts"))
        .filter(F.size("_parts") >= 4)
        .select(
            "seq",
            strip(F.col("_parts")[0]).alias("file_path"),
            _number(F.col("_parts")[1]).alias("line_number"),
            _number(F.col("_parts")[2]).alias("column_number"),
            message.alias("message"),
        )
        .select(
            "seq", "file_path", "line_number", "column_number",
            F.lit(V.ISSUE_TYPE).alias("issue_type"),
            classify.severity(F.col("message")).alias("severity"),
            "message",
            F.lit("").alias("code_snippet"),
            F.lit("").alias("suggested_fix"),
            classify.category(F.col("message")).alias("category"),
            classify.tag(F.col("message")).alias("tag"),
        )
    )


FINDING_DEFAULTS = {
    "file_path": "", "line_number": 0, "column_number": 0, "issue_type": "", "severity": "",
    "message": "", "code_snippet": "", "suggested_fix": "", "category": "",
}
MODIFICATION_DEFAULTS = {
    "file_path": "", "cell_index": -1, "line_number": 0, "change_type": "replace",
    "original_code": "", "modified_code": "", "reason": "", "issue_type": "",
    "confidence_level": 0.8, "requires_testing": True, "breaking_change": False,
    "documentation_needed": False,
}


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill NULL cells and absent columns with their defaults."""
    have = set(df.columns)
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value)
        for name, value in defaults.items()
    }
    return df.withColumns(filled)


def severity_counts(findings: DataFrame) -> DataFrame:
    severity = F.coalesce("severity", F.lit("unknown")).alias("severity")
    return findings.groupBy("file_path", severity).agg(F.count(F.lit(1)).alias("findings"))


def category_counts(findings: DataFrame) -> DataFrame:
    category = F.coalesce("category", F.lit(V.DEFAULT_CATEGORY)).alias("category")
    return findings.groupBy("file_path", category).agg(F.count(F.lit(1)).alias("findings"))


def as_map(counts: DataFrame, label: str) -> DataFrame:
    """One map per file from a long count table (as many entries as labels)."""
    return counts.groupBy("file_path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "findings")))).alias(f"by_{label}")
    )


def finding_totals(findings: DataFrame) -> DataFrame:
    """Per lint path: all counts the scores need, combined before the shuffle."""
    def hits(column: str, value: str, name: str) -> Column:
        return F.count_if(F.col(column) == value).alias(name)

    return findings.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("findings"),
        hits("severity", "error", "errors"),
        hits("severity", "warning", "warnings"),
        hits("severity", "info", "infos"),
        *[hits("category", c, f"cat_{c}") for c in V.CATEGORIES],
        F.max(has(F.lower("category"), "spark")).alias("any_spark"),
        F.max(has(F.lower("message"), "databricks")).alias("any_platform"),
    )


TOTALS = ["findings", "errors", "warnings", "infos", *[f"cat_{c}" for c in V.CATEGORIES]]


def analyse(totals: DataFrame, cells: str | None = None) -> DataFrame:
    """Complexity, effort and the like from per-file totals."""
    code_cells = F.col(cells) if cells else F.lit(0)
    score = scoring.complexity_score(
        code_cells, F.col("errors"), F.col("warnings"), F.col("any_spark"), F.col("any_platform")
    )
    return (
        totals.withColumn("score", score)
        .withColumn("complexity", scoring.complexity_class(F.col("score")))
        .withColumn("effort_hours", scoring.effort_hours(F.col("complexity"), F.col("findings"), code_cells))
    )


def analyse_files(files: DataFrame, file_totals: DataFrame) -> DataFrame:
    """Analysis row of every file; ``file_totals`` is keyed by ``path``."""
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in TOTALS}
    no = {c: F.coalesce(c, F.lit(False)) for c in ("any_spark", "any_platform")}
    joined = files.select("path", "cell_count", "code_cell_count").join(file_totals, "path", "left")
    return analyse(joined.withColumns({**zero, **no}), "code_cell_count")


def findings_arrays(findings: DataFrame, size: int = 1000) -> DataFrame:
    """Findings nested per file, at most ``size`` per row, in input order.

    A file with many findings gives several rows, numbered by ``chunk``; findings
    are counted within their file.
    """
    fields = [c for c in findings.columns if c != "file_path"]
    counted = running_total(findings.withColumn("_one", F.lit(1)), ["file_path"], "seq", "_one", "_earlier")
    return (
        counted.groupBy("file_path", F.floor(F.col("_earlier") / size).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("findings"))
    )


def _first_by_category(findings: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` first findings per file and category, with category totals."""
    keyed = findings.withColumn("category", F.coalesce("category", F.lit(V.DEFAULT_CATEGORY)))
    top = first_rows(
        keyed.select("file_path", "category", "seq", "line_number", "severity", "message"),
        ["file_path", "category"], ["seq"], n,
    )
    totals = keyed.groupBy("file_path", "category").agg(
        F.count(F.lit(1)).alias("total"), F.min("seq").alias("first_seq")
    )
    return (
        top.groupBy("file_path", "category")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "line_number", "severity", "message"))).alias("top"))
        .join(totals, ["file_path", "category"])
    )


def _join_blocks(blocks: DataFrame, name: str) -> DataFrame:
    """One text per file; there is one block per category."""
    ordered = F.array_sort(F.collect_list(F.struct("first_seq", "block")))
    return blocks.groupBy("file_path").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "\n").alias(name)
    )


def category_summary(findings: DataFrame, n: int = 3) -> DataFrame:
    """Per file: a text listing the first findings of each category."""
    lines = F.transform("top", lambda f: F.concat(
        F.lit("  - Line "), f["line_number"].cast("string"),
        F.lit(": ["), f["severity"], F.lit("] "), f["message"],
    ))
    head = F.format_string("\n%s Issues (%d):", F.upper("category"), F.col("total"))
    rest = F.when(
        F.col("total") > n, F.array(F.format_string("  ... and %d more issues", F.col("total") - n))
    ).otherwise(F.expr("cast(array() as array<string>)"))
    block = F.array_join(F.concat(F.array(head), lines, rest), "\n")
    return _join_blocks(_first_by_category(findings, n).withColumn("block", block), "summary")


def planning_summary(findings: DataFrame, n: int = 3) -> DataFrame:
    """The compact form, without line numbers, totals or tail."""
    lines = F.transform("top", lambda f: F.concat(F.lit("  - ["), f["severity"], F.lit("] "), f["message"]))
    head = F.concat(F.lit("\n"), F.upper("category"), F.lit(":"))
    block = F.array_join(F.concat(F.array(head), lines), "\n")
    return _join_blocks(_first_by_category(findings, n).withColumn("block", block), "summary")


def latest_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` of each key, combined map-side."""
    return _extreme(df, keys, order, F.max_by)


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _extreme(df, keys, order, F.min_by)


def _extreme(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def input_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, findings and files with findings."""
    n_files = files.agg(F.count(F.lit(1))).scalar()
    return findings.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_distinct("file_path").alias("files_with_findings"),
    ).select(n_files.alias("files"), "findings", "files_with_findings")


def findings_per_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file_path").agg(F.count(F.lit(1)).alias("findings"))
