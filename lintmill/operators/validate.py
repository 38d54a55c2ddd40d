"""Validating modifications: syntax, compatibility and logic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions import checks
from lintmill.functions.text import strings
from lintmill.operators.skew import first_rows

ISSUE_COLUMNS = {"syntax": "syntax_issues", "compatibility": "compat_issues", "logic": "logic_issues"}


def check(mods: DataFrame, parse: bool = True) -> DataFrame:
    """Modifications with one array of messages per check.

    ``parse=False`` leaves out whether the text compiles as Python and keeps the
    bracket counts, so the whole check stays in the JVM.
    """
    code, original = F.col("modified_code"), F.col("original_code")
    return mods.withColumns({
        "syntax_issues": checks.syntax_issues(code, checks.parse_error(code) if parse else None),
        "compat_issues": checks.compat_issues(code),
        "compat_warnings": checks.compat_warnings(code),
        "logic_issues": checks.logic_issues(original, code),
    })


def issues(checked: DataFrame) -> DataFrame:
    """One row per issue: (file_path, validation_type, seq, pos, issue)."""
    per_type = F.array(*[
        F.struct(F.lit(kind).alias("validation_type"), F.col(column).alias("found"))
        for kind, column in ISSUE_COLUMNS.items()
    ])
    return (
        checked.select("file_path", "seq", F.explode(per_type).alias("_t"))
        .select("file_path", "_t.validation_type", "seq", F.posexplode("_t.found").alias("pos", "issue"))
    )


def validations(files: DataFrame, checked: DataFrame) -> DataFrame:
    """Three rows per file; a file without modifications passes all three.

    Issue texts stay in :func:`issues`; these rows hold their numbers, so no
    file's issues are gathered into one value.
    """
    sums = checked.groupBy(F.col("file_path").alias("path")).agg(
        *[F.sum(F.size(column)).alias(f"_{kind}") for kind, column in ISSUE_COLUMNS.items()],
        F.sum(F.size("compat_warnings")).alias("_warnings"),
    )
    zero = F.lit(0).cast("long")

    def row(kind: str):
        found = F.coalesce(f"_{kind}", zero)
        advice = F.when(found == 0, strings(V.VALIDATION_ADVICE[kind, True])).otherwise(
            strings(V.VALIDATION_ADVICE[kind, False])
        )
        return F.struct(
            F.lit(kind).alias("validation_type"), (found == 0).alias("is_valid"),
            found.alias("issues_found"),
            (F.coalesce("_warnings", zero) if kind == "compatibility" else zero).alias("warnings"),
            (found if kind == "syntax" else zero).alias("syntax_errors"),
            (found if kind == "compatibility" else zero).alias("compatibility_issues"),
            zero.alias("performance_warnings"),
            advice.alias("recommendations"), strings([]).alias("next_steps"),
        )

    return (
        files.select("path").join(sums, "path", "left")
        .select("path", F.explode(F.array(*[row(kind) for kind in V.VALIDATION_TYPES])).alias("_v"))
        .select("path", "_v.*")
    )


def top_issues(found: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` issues of each file and validation type, with ``rank``."""
    return first_rows(found, ["file_path", "validation_type"], ["seq", "pos"], n)


def detail_text(checks_done: DataFrame, found: DataFrame, n: int = 3) -> DataFrame:
    """A short text per file on its three validations and their first issues."""
    top = top_issues(found, n).groupBy(F.col("file_path").alias("path"), "validation_type").agg(
        F.array_sort(F.collect_list(F.struct("rank", "issue"))).alias("_top")
    )
    head = F.format_string(
        "\n%s Validation:\n  Status: %s\n  Issues: %d\n  Warnings: %d",
        F.upper("validation_type"), F.when(F.col("is_valid"), "PASSED").otherwise("FAILED"),
        F.col("issues_found"), F.col("warnings"),
    )
    listed = F.concat(
        F.array(F.lit("  Issues Found:")),
        F.transform("_top", lambda i: F.concat(F.lit("    - "), i["issue"])),
    )
    block = F.array_join(F.concat(F.array(head), F.coalesce(listed, strings([]))), "\n")
    rank = F.array_position(strings(V.VALIDATION_TYPES), F.col("validation_type"))
    blocks = (
        checks_done.join(top, ["path", "validation_type"], "left")
        .select("path", F.struct(rank.alias("rank"), block.alias("block")).alias("_b"))
    )
    return blocks.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda b: b["block"]), "\n").alias("detail")
    )
