"""The order-maintenance list of lines against a plain list."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lintmill.operators import apply
from lintmill.operators.edits import Lines
from tests.test_apply import MODS


def plain(lines, ops):
    state = list(lines)
    for kind, code, text in ops:
        at = next((i for i, (_, held) in enumerate(state) if code in held), None)
        if at is None:
            continue
        if kind == "delete":
            state.pop(at)
        elif kind == "insert":
            state.insert(at, (state[at][0], text))
        else:
            state[at] = (state[at][0], text)
    return state


def edited(lines, ops, codes):
    held = lambda text: frozenset(c for c in codes if c in text)
    out = Lines()
    for number, text in lines:
        out.append(number, text, held(text))
    for kind, code, text in ops:
        out.edit(kind, code, text, held(text))
    labels = [line.label for line in out]
    assert labels == sorted(set(labels))
    return [(line.number, line.text) for line in out if line.text is not None]


@pytest.mark.parametrize("seed", range(60))
def test_edits(seed):
    rng = random.Random(seed)
    word = lambda low: "".join(rng.choices("abc", k=rng.randint(low, 4)))
    codes = [word(0)[:2] for _ in range(4)]
    lines = [(i, word(0)) for i in range(rng.randint(0, 12))]
    ops = [(rng.choice(["insert", "insert", "delete", "replace"]), rng.choice(codes), word(0)) for _ in range(90)]
    assert edited(lines, ops, codes) == plain(lines, ops)


def test_insertions_in_one_place_spread_the_labels():
    ops = [("insert", "a", f"z{i}") for i in range(20_000)]
    got = edited([(0, "a"), (1, "a")], ops, ["a"])
    assert got == [(0, f"z{i}") for i in range(20_000)] + [(0, "a"), (1, "a")]


def test_long_file_of_meeting_lines(spark):
    """100,000 lines that all hold two codes, and as many changes: seconds, not hours."""
    n = 100_000
    lines = spark.range(1, n + 1).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line_no"), F.lit("a b").alias("line"))
    mods = spark.range(n).select(
        F.struct(F.lit(0).alias("proactive"), F.col("id").alias("finding"), F.lit(None).cast("int").alias("cell"), F.lit(0).alias("line")).alias("seq"),
        F.lit("f").alias("file_path"), F.lit(0).alias("line_number"), F.lit("replace").alias("change_type"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("original_code"), F.when(F.col("id") % 2 == 0, "b c").otherwise("d").alias("modified_code"))
    assert mods.schema.simpleString() == spark.createDataFrame([], MODS).schema.simpleString()
    start = time.time()
    out = apply.apply_in_order(lines, mods)
    found = {r.line: r.n for r in out.groupBy("line").agg(F.count(F.lit(1)).alias("n")).collect()}
    # An even change makes the first line "b c", the odd one after it makes that "d".
    assert found == {"d": n // 2, "a b": n // 2}
    assert time.time() - start < 90
