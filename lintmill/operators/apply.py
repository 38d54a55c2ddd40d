"""Applying modifications to lines, and naming the converted files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill import fixed_values as V
from lintmill.functions.text import strip, strings, swap
from lintmill.operators.containment import finder
from lintmill.operators.matching import code_hits
from lintmill.operators.edits import Lines
from lintmill.operators.modify import order_chunk
from lintmill.operators.skew import running_total, salted_join, spread_join
from lintmill.session import materialize

PYTHON_TYPES = ("replace", "insert", "delete")
CELL_TYPES = ("replace", "insert", "delete", "modify")
BATCH = 10_000  # edited lines sent at once
SMALL = 65_536  # lines and changes of one key that are edited whole, in one place
BUCKETS = 65_536


def _by_path(mods: DataFrame) -> DataFrame:
    return mods.withColumnRenamed("file_path", "path")


def apply_at_position(
    lines: DataFrame, mods: DataFrame, keys: list[str] | None = None, first_line: int = 1
) -> DataFrame:
    """Lines with the earliest modification of their position put in.

    ``first_line`` is the number of the first line in ``lines``; modifications
    count from 0. Lines come back with ``applied`` telling which ones changed.
    """
    keys = keys or ["path"]
    winners = (
        _by_path(mods).withColumn("line_no", F.col("line_number") + first_line)
        .groupBy(*keys, "line_no").agg(F.min_by("modified_code", "seq").alias("_new"))
    )
    return lines.join(winners, [*keys, "line_no"], "left").select(
        *keys, "line_no", F.coalesce("_new", "line").alias("line"),
        F.col("_new").isNotNull().alias("applied"),
    )


def apply_in_order(
    lines: DataFrame, mods: DataFrame, keys: list[str] | None = None, kinds: tuple[str, ...] = PYTHON_TYPES
) -> DataFrame:
    """Apply modifications one after the other, each to the first line holding its code.

    Rows come back as (keys, line_no, part, line, applied); ``part`` orders lines that
    were inserted in front of ``line_no``, ``applied`` tells which ones changed.
    """
    return fold(lines, mods, keys, kinds).filter("line is not null")


def fold(
    lines: DataFrame, mods: DataFrame, keys: list[str] | None = None, kinds: tuple[str, ...] = PYTHON_TYPES
) -> DataFrame:
    """As ``apply_in_order``, with deleted lines as NULL.

    Lines and changes move once, to the place of their key. Keys with more than
    ``SMALL`` of both are worked out apart (``_fold_large``), so a task never holds more.
    """
    keys = keys or ["path"]
    lines, changes = lines.select(*keys, "line_no", "line"), mods.filter(F.col("change_type").isin(*kinds))
    placed = _by_path(changes).dropna(subset=keys)
    large = _large_keys(lines, placed, keys, SMALL)
    if large is None:
        return _fold_small(lines, placed, keys)
    own = large.withColumnsRenamed({"path": "file_path"})
    return _fold_small(lines.join(large, keys, "left_anti"), placed.join(large, keys, "left_anti"), keys).unionByName(
        _fold_large(lines.join(large, keys, "left_semi"), changes.join(own, own.columns, "left_semi"), keys, kinds))


def _large_keys(lines: DataFrame, changes: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """Keys with more lines and changes than ``most``; None if there are none.

    Rows are counted by a hash of the key first, so few numbers move; only keys of
    full buckets are counted themselves.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket")
    both = lines.select(*keys, bucket).unionByName(changes.select(*keys, bucket)).dropna(subset=keys)
    full = materialize(both.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_bucket"), "full")
    if full.isEmpty():
        return None
    counted = both.join(full, "_bucket", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(counted.filter(F.col("_n") > most).select(*keys), "large")
    return None if large.isEmpty() else large


def _schema(lines: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([
        *[lines.schema[k] for k in keys], T.StructField("line_no", T.IntegerType()), T.StructField("part", T.IntegerType()),
        T.StructField("line", T.StringType()), T.StructField("applied", T.BooleanType()),
    ])


def _fold_small(lines: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's changes played on its lines. Rows come by key, changes first.

    Lines of keys without changes go through as they are, a batch at a time; of the
    others one key is held at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n_keys, schema = len(keys), _schema(lines, keys)
    arrow = to_arrow_schema(schema)

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        """Numbers the runs of equal keys in a batch, from 0."""
        new = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:n_keys]:
            new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    def edited(key: tuple, changes: list[tuple], lines: list[tuple]) -> list[tuple]:
        find, known, state = finder(list({code for _, _, code in changes})), {}, Lines()

        def held(text: str | None) -> frozenset[str]:
            if text is None:
                return frozenset()
            if text not in known:
                known[text] = frozenset(find(text.strip(V.SPACES)))
            return known[text]

        for number, text in lines:
            state.append(number, text, held(text))
        for kind, text, code in changes:
            state.edit(kind, code, text, frozenset() if kind == "delete" else held(text))
        return [(*key, *row) for row in _numbered(state)]

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, changes, held, rows = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            run, change = runs(batch), batch.column("kind").is_valid().to_numpy(zero_copy_only=False)
            played = np.zeros(run[-1] + 1, bool)
            played[run[change]] = True
            if key is not None and tuple(c[0].as_py() for c in batch.columns[:n_keys]) == key:
                played[0] = True  # begun in the batch before
            taken = played[run]
            idle = batch.filter(pa.array(~taken))
            if idle.num_rows:
                yield pa.RecordBatch.from_arrays([
                    *idle.columns[:n_keys], idle.column("number"), pa.array(np.zeros(idle.num_rows, np.int32)), idle.column("text"),
                    pa.array(np.zeros(idle.num_rows, bool))], schema=arrow)
            for row in zip(*[column.to_pylist() for column in batch.filter(pa.array(taken)).columns]):
                if row[:n_keys] != key:
                    if key is not None:
                        rows += edited(key, changes, held)
                        if len(rows) >= BATCH:
                            yield _batch(rows, arrow)
                            rows = []
                    key, changes, held = row[:n_keys], [], []
                kind, number, text, code = row[n_keys:]
                if kind is None:
                    held.append((number, text))
                elif code is not None:
                    changes.append((kind, text, code))
        if key is not None:
            rows += edited(key, changes, held)
        if rows:
            yield _batch(rows, arrow)

    none = F.lit(None)
    stream = changes.select(
        *keys, F.col("change_type").alias("kind"), none.cast("int").alias("number"), F.col("modified_code").alias("text"),
        strip(F.col("original_code")).alias("code"), F.lit(0).alias("_turn"), F.col("seq").alias("_seq"),
    ).unionByName(lines.select(
        *keys, none.cast("string").alias("kind"), F.col("line_no").cast("int").alias("number"), F.col("line").alias("text"),
        none.cast("string").alias("code"), F.lit(1).alias("_turn"), none.cast(changes.schema["seq"].dataType).alias("_seq"),
    ))
    return (
        stream.repartition(*keys).sortWithinPartitions(*keys, "_turn", "number", "_seq")
        .select(*keys, "kind", "number", "text", "code").mapInArrow(play, schema)
    )


def _numbered(state: Lines) -> Iterator[tuple]:
    """(line_no, part, line, applied) of edited lines; ``part`` counts those in front of a line."""
    number, part = None, 0
    for line in state:
        if line.number != number:
            number, part = line.number, 0
        yield number, part, line.text, line.edited
        part += line.text is not None


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _fold_large(lines: DataFrame, mods: DataFrame, keys: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """``fold`` for keys with more lines and changes than a task should hold.

    A code whose lines hold no other code, before or after any change, does not
    meet the others. For such codes the order is worked out set-based: a change
    that removes the code from its line moves the next change on to the next
    line. Only codes that meet each other, and the lines they touch, are edited
    in sequence, per key.
    """
    ops = (
        _by_path(mods).filter(F.col("change_type").isin(*kinds))
        .withColumn("code", strip(F.col("original_code")))
        .withColumn("_after", F.when(F.col("change_type") != "delete", strip(F.col("modified_code"))))
        .withColumn("_chunk_key", order_chunk(mods))
        .select(*keys, "seq", "_chunk_key", "change_type", "code", "modified_code", "_after")
    )
    numbered = lines.select(*keys, "line_no", "line").withColumn("text", strip(F.col("line")))
    codes = ops.groupBy(*keys, "code").agg(
        F.max(F.col("change_type") == "insert").alias("_inserts")
    )
    results = ops.filter("_after is not null").select(*keys, "code", F.col("_after").alias("text")).distinct()
    sizes = numbered.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n"))
    texts = sizes.select(*keys, "text").union(results.select(*keys, "text")).distinct()
    hits = materialize(code_hits(texts, codes, keys), "hits")

    # Codes that meet: on one text, or because one's result holds the other.
    crowded = hits.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    on_text = hits.join(crowded.drop("_n"), [*keys, "text"]).select(*keys, "code")
    foreign = salted_join(
        hits.withColumnRenamed("code", "_hit"), results, [*keys, "text"], "_hit"
    ).filter("_hit <> code")
    meets = F.explode(F.array("_hit", "code"))
    entangled = (
        on_text
        .union(foreign.select(*keys, meets.alias("code")))
        .union(codes.filter(F.col("_inserts") | (F.col("code") == "")).select(*keys, "code"))
        .distinct().withColumn("_tangled", F.lit(True))
    )
    hits = materialize(hits.join(entangled, [*keys, "code"], "left"), "hits")
    entangled = hits.filter("_tangled").select(*keys, "code").distinct()
    touched = materialize(spread_join(numbered, hits, [*keys, "text"], "line_no", sizes).drop("text"), "touched")
    holds = hits.select(*keys, "code", F.col("text").alias("_after")).withColumn("_stays", F.lit(True))
    changed = _free_changes(
        touched.filter("_tangled is null").select(*keys, "code", "line_no"),
        ops.join(entangled, [*keys, "code"], "left_anti"), holds.filter("_tangled is null"), keys,
    )
    held = hits.filter("_tangled").groupBy(*keys, F.col("text").alias("_after")).agg(F.collect_list("code").alias("codes"))
    played = _edited(
        touched.filter("_tangled").groupBy(*keys, "line_no").agg(F.first("line").alias("line"), F.collect_list("code").alias("codes")),
        ops.join(entangled, [*keys, "code"], "left_semi").join(held, [*keys, "_after"], "left"), keys,
    )
    new = changed.select(*keys, "line_no", F.lit(0).alias("part"), "line", F.lit(True).alias("applied")).unionByName(played)
    handled = changed.select(*keys, "line_no").union(touched.filter("_tangled").select(*keys, "line_no")).distinct()
    return numbered.join(handled, [*keys, "line_no"], "left_anti").select(
        *keys, "line_no", F.lit(0).alias("part"), "line", F.lit(False).alias("applied")
    ).unionByName(new)


def _free_changes(touched: DataFrame, ops: DataFrame, holds: DataFrame, keys: list[str]) -> DataFrame:
    """Final text per changed line, for codes that do not meet; NULL if deleted."""
    moved = (
        ops.join(holds, [*keys, "code", "_after"], "left")
        .withColumn("_moves", F.when(F.col("_stays"), 0).otherwise(1))
    )
    rank = running_total(moved, [*keys, "code"], "seq", "_moves", "_rank", chunk=F.col("_chunk_key"))
    last = rank.groupBy(*keys, "code", "_rank").agg(
        F.max_by(
            F.struct(F.when(F.col("change_type") != "delete", F.col("modified_code")).alias("line")), "seq"
        ).alias("_new")
    )
    ranked = running_total(
        touched.withColumn("_one", F.lit(1)), [*keys, "code"], "line_no", "_one", "_rank"
    ).drop("_one")
    return ranked.join(last, [*keys, "code", "_rank"]).select(*keys, "line_no", "_new.line")


def _edited(lines: DataFrame, ops: DataFrame, keys: list[str]) -> DataFrame:
    """Edit lines in sequence. Both sides carry ``codes``, those that their texts hold.

    Rows of a key come in order, lines first, then changes, and are taken one by
    one: only the lines a key's changes may touch are held, never the changes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n_keys, schema = len(keys), _schema(lines, keys)
    arrow = to_arrow_schema(schema)

    def edited(key: tuple, state: Lines) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in _numbered(state):
            rows.append((*key, *row))
            if len(rows) == BATCH:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, Lines()
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if row[:n_keys] != key:
                    if key is not None:
                        yield from edited(key, state)
                    key, state = row[:n_keys], Lines()
                kind, number, text, code, codes = row[n_keys:]
                held = frozenset(codes or ())
                if kind == "line":
                    state.append(number, text, held)
                else:
                    state.edit(kind, code, text, held)
        if key is not None:
            yield from edited(key, state)

    none = F.lit(None)
    empty_seq = none.cast(ops.schema["seq"].dataType)
    stream = lines.select(
        *keys, F.lit("line").alias("kind"), F.col("line_no").cast("int").alias("number"), F.col("line").alias("text"),
        F.lit("").alias("code"), "codes", F.lit(0).alias("_turn"), empty_seq.alias("_seq"),
    ).unionByName(ops.select(
        *keys, F.col("change_type").alias("kind"), none.cast("int").alias("number"),
        F.col("modified_code").alias("text"), "code", "codes", F.lit(1).alias("_turn"), F.col("seq").alias("_seq"),
    ))
    return (
        stream.repartition(*keys).sortWithinPartitions(*keys, "_turn", "number", "_seq")
        .select(*keys, "kind", "number", "text", "code", "codes").mapInArrow(play, schema)
    )


def conversions(files: DataFrame, mods: DataFrame) -> DataFrame:
    """One row per file; files without modifications say so."""
    applied = mods.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("modifications_applied"))
    return files.select("path", "filename", "file_type").join(applied, "path", "left").select(
        "path", converted_name().alias("converted_path"), "filename",
        F.coalesce("modifications_applied", F.lit(0).cast("long")).alias("modifications_applied"),
        F.when(F.col("modifications_applied").isNull(), "no_modifications_needed")
        .otherwise("converted").alias("status"),
    )


def converted_name():
    """Output name of ``filename``; every ``.py`` / ``.ipynb`` in it is dropped."""
    def named(extension: str):
        return F.concat(swap(F.col("filename"), extension, ""), F.lit(V.CONVERTED_SUFFIX + extension))

    return F.when(F.col("file_type") == "python", named(".py")).otherwise(named(".ipynb"))


def converted_lines(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Lines of converted Python files: the header (part 0), then the body (part 1).

    Only files with a changed line are converted. ``path`` tells files of one name apart.
    ``applied`` is the output of ``apply_at_position`` or of ``fold``, whose inserted
    lines are told apart by ``sub`` and whose deleted lines count as changes.
    """
    sub = [F.col("part").alias("sub")] if "part" in applied.columns else []
    applied = materialize(applied.select("path", "line_no", *sub, "line", "applied"), "applied")
    changed = (
        applied.filter("applied").select("path").distinct()
        .join(files.select("path", "filename", "file_type"), "path")
        .select("path", converted_name().alias("converted_path"))
    )
    header = changed.select(
        "path", "converted_path", F.lit(0).alias("part"),
        F.posexplode(strings(V.PYTHON_HEADER)).alias("line_no", "line"), *[F.lit(0).alias("sub") for _ in sub],
    )
    body = applied.filter("line is not null").join(changed, "path").select(
        "path", "converted_path", F.lit(1).alias("part"), "line_no", "line", *(["sub"] if sub else []))
    return header.unionByName(body)


def converted_cells(cells: DataFrame, applied: DataFrame) -> DataFrame:
    """Cells of converted notebooks, a markdown cell put in front.

    ``applied`` holds the applied lines of code cells; a cell without a changed line
    keeps its source. Cells are numbered anew. Where cells carry ``raw``, their JSON,
    it goes along, with ``changed`` telling whether ``source`` replaces its source.
    """
    changed = applied.filter("applied").select("path").distinct()
    rebuilt = applied.groupBy("path", "cell_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda l: l["line"]).alias("_source"),
        F.max("applied").alias("_any"),
    ).filter("_any")
    raw = [c for c in ("raw",) if c in cells.columns]
    body = (
        cells.join(changed, "path", "left_semi").join(rebuilt, ["path", "cell_index"], "left")
        .select("path", (F.col("cell_index") + 1).alias("cell_index"), "cell_type",
                F.coalesce("_source", "source").alias("source"),
                *raw, *[F.col("_source").isNotNull().alias("changed") for _ in raw])
    )
    front = changed.select(
        "path", F.lit(0).alias("cell_index"), F.lit("markdown").alias("cell_type"),
        strings(V.NOTEBOOK_HEADER).alias("source"),
        *[F.lit(None).cast("string").alias(c) for c in raw], *[F.lit(True).alias("changed") for _ in raw],
    )
    return front.unionByName(body)


def converted_metadata(metadata):
    """Notebook metadata (a map of JSON texts) with the three conversion entries."""
    return F.map_concat(
        F.map_filter(metadata, lambda k, v: ~k.isin(
            "unity_catalog_converted", "conversion_timestamp", "conversion_tool")),
        F.create_map(
            F.lit("unity_catalog_converted"), F.lit("true"),
            F.lit("conversion_timestamp"),
            F.concat(F.lit('"'), F.current_timestamp().cast("string"), F.lit('"')),
            F.lit("conversion_tool"), F.lit(f'"{V.CONVERSION_TOOL}"'),
        ),
    )
