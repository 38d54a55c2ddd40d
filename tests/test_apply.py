"""Applying modifications against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lintmill.operators import apply
from tests.conftest import rows

SEQ = "struct<proactive int, finding bigint, cell int, line int>"
MODS = f"seq {SEQ}, file_path string, line_number int, change_type string, original_code string, modified_code string"


def play(lines, mods, kinds):
    """Changes one after the other, each on the first line that holds its code."""
    state = {}
    for path, no, text in sorted(lines):
        state.setdefault(path, []).append(text)
    for (_, path, _, kind, code, new) in sorted(mods, key=lambda m: m[0]):
        texts = state.get(path, [])
        for i, text in enumerate(texts):
            if code.strip() in text.strip():
                if kind not in kinds:
                    pass
                elif kind == "delete":
                    texts.pop(i)
                elif kind == "insert":
                    texts.insert(i, new)
                else:
                    texts[i] = new
                break
    return state


def _case(seed, words, kinds, n_mods):
    rng = random.Random(seed)
    lines = [
        (f"f{f}", n, rng.choice(["", "  "]) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 2))))
        for f in range(6) for n in range(1, 12)
    ]
    mods = [
        ((0, s, None, None), f"f{rng.randint(0, 6)}", 0, rng.choice(kinds),
         rng.choice(words + ["  " + words[0], ""] if seed % 2 else words),
         " ".join(rng.choice(words + ["new", "zz"]) for _ in range(rng.randint(1, 2))))
        for s in range(n_mods)
    ]
    rng.shuffle(mods)
    return lines, mods


@pytest.mark.parametrize("seed", range(6))
def test_in_order(spark, seed):
    words = [["a", "ab", "b", "abc"], ["one", "two", "three", "four", "five", "six"]][seed % 3 == 0]
    lines, mods = _case(seed, words, ["replace", "replace", "insert", "delete", "modify"], 60)
    for kinds in (apply.PYTHON_TYPES, apply.CELL_TYPES) if seed < 2 else (apply.PYTHON_TYPES,):
        out = apply.apply_in_order(
            spark.createDataFrame(lines, "path string, line_no int, line string"),
            spark.createDataFrame(mods, MODS), kinds=kinds,
        )
        got = {}
        for r in sorted(out.collect(), key=lambda r: (r.path, r.line_no, r.part)):
            got.setdefault(r.path, []).append(r.line)
        assert got == {p: t for p, t in play(lines, mods, kinds).items() if t}


def test_independent_codes_are_not_played(spark):
    """Codes that do not meet follow the same order without a sequential pass."""
    rng = random.Random(1)
    codes = [f"code{i:02d}x" for i in range(20)]
    lines = [("f", n, f"  {rng.choice(codes)} = {n}") for n in range(1, 200)]
    mods = [
        ((0, s, None, None), "f", 0, rng.choice(["replace", "replace", "delete"]), code,
         rng.choice([f"done {s}", f"{code} stays {s}"]))
        for s, code in enumerate(rng.choices(codes, k=150))
    ]
    df = spark.createDataFrame(lines, "path string, line_no int, line string")
    out = apply.apply_in_order(df, spark.createDataFrame(mods, MODS))
    got = [r.line for r in sorted(out.collect(), key=lambda r: (r.line_no, r.part))]
    assert got == play(lines, mods, apply.PYTHON_TYPES)["f"]


def test_position_and_order_agree_when_codes_are_unique(spark):
    lines = [("f", n, f"  value_{n:03d} = {n}") for n in range(1, 50)]
    mods = [
        ((0, n, None, None), "f", n - 1, "replace", f"value_{n:03d} = {n}", f"changed {n}") for n in range(1, 50, 3)
    ]
    df, changes = spark.createDataFrame(lines, "path string, line_no int, line string"), spark.createDataFrame(mods, MODS)
    by_position = apply.apply_at_position(df, changes)
    in_order = apply.apply_in_order(df, changes)
    assert rows(by_position, "line_no", "line") == rows(in_order, "line_no", "line")


def test_earliest_modification_wins(spark):
    df = spark.createDataFrame([("f", 1, "x")], "path string, line_no int, line string")
    mods = [((1, None, 0, 0), "f", 0, "replace", "x", "proactive"), ((0, 9, None, None), "f", 0, "replace", "x", "late"),
            ((0, 2, None, None), "f", 0, "replace", "x", "early")]
    out = apply.apply_at_position(df, spark.createDataFrame(mods, MODS))
    assert rows(out) == [("f", 1, "early", True)]


def test_converted_names(spark):
    df = spark.createDataFrame([("a.py.bak.py", "python"), ("n.ipynb", "notebook")], "filename string, file_type string")
    assert rows(df.select(apply.converted_name())) == [("a.bak_unity_catalog.py",), ("n_unity_catalog.ipynb",)]


def test_converted_metadata(spark):
    df = spark.createDataFrame([({"kernel": '"k"'},)], "metadata map<string,string>")
    got = df.select(apply.converted_metadata(F.col("metadata")).alias("m")).first().m
    assert set(got) == {"kernel", "unity_catalog_converted", "conversion_timestamp", "conversion_tool"}


@pytest.mark.parametrize("small", [0, 25, 65_536])
def test_keys_of_any_size_are_folded_alike(spark, monkeypatch, small):
    """Large keys go apart, small ones whole; nothing is lost between them, nor changes without a file."""
    monkeypatch.setattr(apply, "SMALL", small)
    lines, mods = _case(2, ["a", "ab", "b", "abc"], ["replace", "insert", "delete"], 90)
    lines += [("idle", n, f"line {n}") for n in range(5)] + [(None, 1, "a")] + [("f0", 50 + n, "a b") for n in range(20)]
    mods += [((0, 900, None, None), None, 0, "delete", "a", "x"), ((0, 901, None, None), "none", 0, "replace", "a", "x")]
    out = apply.apply_in_order(spark.createDataFrame(lines, "path string, line_no int, line string"), spark.createDataFrame(mods, MODS))
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.path or "", r.line_no, r.part)):
        got.setdefault(r.path, []).append(r.line)
    expected = play([l for l in lines if l[0]], [m for m in mods if m[1]], apply.PYTHON_TYPES)
    assert got == {p: t for p, t in expected.items() if t} | {None: ["a"]}


def test_small_keys_move_once(spark):
    lines, mods = _case(1, ["a", "ab", "b"], ["replace", "insert", "delete"], 60)
    out = apply.fold(spark.createDataFrame(lines, "path string, line_no int, line string"), spark.createDataFrame(mods, MODS))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_converted_lines_fold_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "path string, line_no int, part int, line string, applied boolean"
    applied = spark.createDataFrame([("f.py", 1, 0, "x", True), ("f.py", 2, 0, "y", False)], schema).mapInArrow(count, schema)
    files = spark.createDataFrame([("f.py", "f.py", "python")], "path string, filename string, file_type string")
    apply.converted_lines(files, applied).collect()
    assert seen.value == 2
