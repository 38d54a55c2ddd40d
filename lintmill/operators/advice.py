"""Parsing advice texts into lists of lines and plan sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill import fixed_values as V
from lintmill.functions.text import has, is_code, split_lines, strip, strip_chars
from lintmill.operators.skew import carry_forward


def advice_lines(text: Column, n: int = 5) -> Column:
    """The first ``n`` lines that are not blank or headings, without bullets."""
    kept = F.filter(split_lines(text), is_code)
    return F.slice(F.transform(kept, lambda l: strip(strip_chars(l, "- "))), 1, n)


def _heading(line: Column) -> Column:
    text, chain = F.upper(line), F
    for section, words in V.SECTION_WORDS:
        chain = chain.when(reduce(lambda a, b: a & b, [has(text, w) for w in words]), F.lit(section))
    return chain.otherwise(F.lit(None).cast("string"))


def _step(line: Column) -> Column:
    listed = line.rlike(r"^[-\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]")
    text = strip(F.regexp_replace(line, r"^[0-9.\-]+", ""))
    return F.when(listed & (text != ""), text)


def section_steps(lines: DataFrame) -> DataFrame:
    """Steps per section of each document: (doc, section, pos, step).

    ``lines`` holds (doc, pos, line). A heading line opens a section; bullet and
    numbered lines under it are its steps.
    """
    line = strip(F.col("line"))
    headed = lines.select(
        "doc", "pos", line.alias("line"), _heading(line).alias("heading")
    )
    return (
        carry_forward(headed, ["doc"], "pos", "heading", "section")
        .filter("heading is null and section is not null")
        .select("doc", "section", "pos", _step(F.col("line")).alias("step"))
        .filter("step is not null")
    )


def sections(lines: DataFrame) -> DataFrame:
    """Like :func:`section_steps`, with default steps (pos -1) for empty sections."""
    steps = section_steps(lines)
    all_sections = F.array(*[
        F.struct(
            F.lit(name).alias("section"),
            F.array(*[F.lit(s) for s in V.EMPTY_SECTION_STEPS[name]]).alias("steps"),
        )
        for name, _ in V.SECTION_WORDS
    ])
    empty = (
        lines.select("doc").distinct().withColumn("_s", F.explode(all_sections))
        .select("doc", "_s.section", "_s.steps")
        .join(steps.select("doc", "section").distinct(), ["doc", "section"], "left_anti")
        .select("doc", "section", F.lit(-1).cast("long").alias("pos"), F.explode("steps").alias("step"))
    )
    return steps.withColumn("pos", F.col("pos").cast("long")).unionByName(empty)


def as_lines(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """Whole texts to (doc, pos, line) rows."""
    return texts.select(F.col(doc).alias("doc"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
