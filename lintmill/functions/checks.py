"""Checks on modified code; each returns an array of messages."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill import fixed_values as V
from lintmill.functions.text import count_of, has, has_any_case, present, strings


def bracket_issues(code: Column) -> Column:
    return present(*[
        F.when(count_of(code, left) != count_of(code, right), F.lit(message))
        for left, right, message in V.BRACKET_MESSAGES
    ])


@F.pandas_udf(T.StringType())
def parse_error(code: pd.Series) -> pd.Series:
    """Message of the first parse error, NULL where the code compiles."""
    seen: dict[str, str | None] = {}

    def check(text: str | None) -> str | None:
        if not text:
            return None
        if text not in seen:
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    compile(text, "<string>", "exec")
                seen[text] = None
            except SyntaxError as error:
                seen[text] = f"Syntax error: {error}"
            except Exception as error:  # null bytes, recursion depth
                seen[text] = f"Code issue: {error}"
        return seen[text]

    return code.map(check)


def syntax_issues(code: Column, parsed: Column | None = None) -> Column:
    found = bracket_issues(code)
    if parsed is not None:
        found = F.concat(present(parsed), found)
    return F.when(code != "", found).otherwise(strings([]))


def _messages(names: Column, before: str, after: str) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(before), n, F.lit(after)))


def compat_issues(code: Column) -> Column:
    queried = F.filter(
        F.regexp_extract_all(code, F.lit(f"(?i){V.FROM_NAME}"), 1),
        lambda n: ~n.isin(*V.NAMES_NOT_TABLES),
    )
    none = strings([])
    return F.concat(
        F.when(
            has(code, "spark.sql(") & has_any_case(code, "FROM "),
            _messages(queried, "Table '", "' should use three-part naming"),
        ).otherwise(none),
        F.when(
            has(code, "spark.read.table("),
            _messages(
                F.regexp_extract_all(code, F.lit(V.READ_CALL), 1),
                "Table '", "' should use catalog.schema.table format",
            ),
        ).otherwise(none),
        F.when(has(F.lower(code), V.LEGACY_CATALOG), strings([V.HIVE_MESSAGE])).otherwise(none),
    )


def compat_warnings(code: Column) -> Column:
    return present(*[
        F.when(has_any_case(code, word) if ignore_case else has(code, word), F.lit(message))
        for word, ignore_case, message in V.COMPAT_WARNINGS
    ])


def logic_issues(original: Column, modified: Column) -> Column:
    def matches(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    reads = has(original, "read.table") & has(modified, "read.table")
    selects = has_any_case(original, "SELECT") & has_any_case(modified, "SELECT")
    return present(
        F.when(
            reads & (matches(original, V.READ_NAME) != matches(modified, V.READ_QUALIFIED)),
            F.lit(V.TABLE_COUNT_MESSAGE),
        ),
        F.when(
            selects & (matches(original, V.SQL_KEYWORDS) != matches(modified, V.SQL_KEYWORDS)),
            F.lit(V.SQL_SHAPE_MESSAGE),
        ),
    )
