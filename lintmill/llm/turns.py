"""Conversations in order, without a group that holds a whole conversation.

Rows are range-partitioned by conversation, turn, role and a hash of the text, so a
conversation that owns a third of all rows is spread over many tasks, and identical
rows are split too. A task then reads its rows in order and cuts them into segments: a
whole conversation at once if it is short and other tasks cannot hold a piece of it,
else bounded runs of rows numbered by ``at``, which ascends within a conversation.

NULL conversations and turns come first, as Spark sorts them; a NULL conversation is
one conversation. Rows of one turn go by role, then by a hash of the text (xxhash64).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 4096      # rows of a segment
SIZE = 1 << 20   # characters of a segment, at most one row more
BATCH = 512      # rows turned into Python values at once


@dataclass
class Segment:
    conv: object
    at: int       # ascends within a conversation
    whole: bool   # no other segment holds rows of this conversation
    rows: list[tuple] = field(default_factory=list)


def in_order(rows: DataFrame, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Partitions that follow each other in the order of conversations and turns."""
    keyed = rows.withColumns({"_hash": F.xxhash64(text), "_uid": F.monotonically_increasing_id()})
    order = [F.col(conv).asc(), F.col(turn).asc(), F.col(role).asc(), F.col("_hash"), F.col("_uid")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash", "_uid")


def segments(
    batches: Iterator[pa.RecordBatch], columns: list[str], size: Callable[[tuple], int], rows: int = ROWS, most: int = SIZE
) -> Iterator[Segment]:
    """Cuts a task's ordered rows. ``columns`` starts with the conversation; ``size`` weighs a row."""
    first = TaskContext.get().partitionId() << 32
    held, weight, count, edge, cut = None, 0, 0, True, False
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            for row in zip(*[part[c].to_pylist() for c in columns], strict=True):
                if held is not None and row[0] == held.conv and (len(held.rows) >= rows or weight >= most):
                    held.whole, cut = False, True
                    yield held
                    held = None
                elif held is not None and row[0] != held.conv:
                    held.whole = not (edge or cut)
                    yield held
                    held, edge, cut = None, False, False
                if held is None:
                    held, weight, count = Segment(row[0], first + count, False), 0, count + 1
                held.rows.append(row[1:])
                weight += size(row)
    if held is not None:
        yield held


def streamed(df: DataFrame, order: list, work, schema: T.StructType) -> DataFrame:
    """Runs ``work`` over each conversation's few or narrow rows, in order, one batch at a time."""
    return df.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(work, schema)
