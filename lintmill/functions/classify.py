"""Classifiers for finding messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions.text import has


def first_hit(cases: list[tuple[Column, object]], default) -> Column:
    """Value of the first true case, else the default."""
    chain = reduce(lambda acc, case: acc.when(case[0], F.lit(case[1])), cases, F)
    return chain.otherwise(F.lit(default))


def severity(message: Column) -> Column:
    text = F.lower(message)
    return first_hit([(has(text, w), w) for w in V.SEVERITY_WORDS], V.DEFAULT_SEVERITY)


def category(message: Column) -> Column:
    text = F.lower(message)
    return first_hit([(has(text, w), name) for w, name in V.CATEGORY_WORDS], V.DEFAULT_CATEGORY)


def tag(message: Column) -> Column:
    """The bracketed word the linter puts in front, or an empty string."""
    return F.regexp_extract(message, r"\[([^\]]+)\]", 1)


def confidence(message: Column) -> Column:
    text = F.lower(message)
    cases = []
    for score, words in V.CONFIDENCE_WORDS:
        cases.append((reduce(lambda a, b: a | b, [has(text, w) for w in words]), score))
    return first_hit(cases, V.DEFAULT_CONFIDENCE)
