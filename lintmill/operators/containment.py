"""Which texts hold which codes: each text is read once, by an automaton of its key's codes.

Codes of a key are compiled into an Aho-Corasick automaton (goto and failure links), which
finds all codes in one pass over a text; a handful of codes is searched for directly. No
text is cut into substrings. Texts stream past the codes and are not held; a key with
more texts or codes than a task should take is cut on both sides by its own counts,
and every part of its texts meets every part of its codes once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.session import materialize

TEXTS = 262_144  # texts of one key that one task reads
CODES = 65_536   # codes of one key that one automaton holds
FEW = 8          # so many codes are searched for one by one
BATCH = 10_000   # rows sent at once


def finder(codes: list[str]) -> Callable[[str], list[str]]:
    """A function that lists the codes a text holds, each once."""
    if len(codes) <= FEW:
        return lambda text: [c for c in codes if c in text]
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for code in codes:
        if code:
            automaton.add_word(code, code)
    automaton.make_automaton()
    everywhere = [""] if "" in codes else []
    return lambda text: [*everywhere, *{code for _, code in automaton.iter(text)}]


def _parts(df: DataFrame, keys: list[str], most: int, name: str) -> DataFrame | None:
    """Keys with more rows than ``most``, and in how many parts they go; None if there are none."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most)
    hot = materialize(counted.select(*keys, F.ceil(F.col("_rows") / most).cast("int").alias(name)), "hot")
    return None if hot.isEmpty() else hot


def _cells(df: DataFrame, keys: list[str], own: DataFrame | None, other: DataFrame | None, value: str, mine: str, others: str) -> DataFrame:
    """Rows with the cell (text part, code part) they go to: one part of their own, all of the other side."""
    for hot in (own, other):
        if hot is not None:
            df = df.join(hot, keys, "left")
    part = F.lit(0) if own is None else F.pmod(F.xxhash64(value), F.coalesce(f"{mine}s", F.lit(1))).cast("int")
    every = F.lit(0) if other is None else F.explode(F.sequence(F.lit(0), F.coalesce(f"{others}s", F.lit(1)) - 1))
    return df.withColumn(mine, part).withColumn(others, every)


def _scanned(texts: DataFrame, codes: DataFrame, keys: list[str], number: str | None) -> DataFrame:
    """Texts meet codes; (keys, text, code), or (keys, first number, code) where ``number`` is a column."""
    many_texts, many_codes = _parts(texts, keys, TEXTS, "_texts"), _parts(codes, keys, CODES, "_codes")
    value = number or "text"
    left = _cells(texts.select(*keys, "text", *([number] if number else [])), keys, many_texts, many_codes, "text", "_text", "_code")
    right = _cells(codes.select(*keys, "code"), keys, many_codes, many_texts, "code", "_code", "_text")
    place = [*keys, "_text", "_code"]
    no = F.lit(None).cast(texts.schema[number].dataType if number else "int")
    stream = right.select(*place, F.lit(0).alias("_kind"), F.col("code").alias("_value"), no.alias("_number")).unionByName(
        left.select(*place, F.lit(1).alias("_kind"), F.col("text").alias("_value"), (F.col(number) if number else no).alias("_number")))
    schema = T.StructType([
        *[texts.schema[k] for k in keys], T.StructField(value, texts.schema[value].dataType), T.StructField("code", T.StringType())])
    n_keys, n_place = len(keys), len(place)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, cell, held, find, first, rows = to_arrow_schema(schema), None, [], None, {}, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if row[:n_place] != cell:
                    rows.extend((*cell[:n_keys], n, code) for code, n in first.items())
                    cell, held, find, first = row[:n_place], [], None, {}
                kind, text, n = row[n_place:]
                if kind == 0:
                    held.append(text)
                    continue
                if text is None or not held:
                    continue
                if find is None:
                    find = finder(held)
                for code in find(text):
                    if number is None:
                        rows.append((*cell[:n_keys], text, code))
                    elif code not in first or n < first[code]:
                        first[code] = n
                if len(rows) >= BATCH:
                    yield batch_of(rows)
                    rows = []
        if cell is not None:
            rows.extend((*cell[:n_keys], n, code) for code, n in first.items())
        yield batch_of(rows)

    return (
        stream.repartition(*place).sortWithinPartitions(*place, "_kind")
        .select(*place, "_kind", "_value", "_number").mapInArrow(scan, schema)
    )


def hits(texts: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, code) of distinct (keys, text) and distinct (keys, code)."""
    return _scanned(texts, codes, keys, None)


def first_hits(texts: DataFrame, codes: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, code) with the least ``number`` of a text that holds the code; texts may repeat."""
    return _scanned(texts, codes, keys, number).groupBy(*keys, "code").agg(F.min(number).alias(number))
