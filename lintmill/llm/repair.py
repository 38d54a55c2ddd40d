"""Conversation structure repair: faults of rows, and the cheapest edits that mend the roles.

Rows are sorted over all tasks (``turns``). A task that holds a whole conversation
finishes it at once: one pass finds the faults, one search the cheapest script
(``audits``). Conversations that are long, or that lie at the edge of a task, are cut
into segments, and what they need of each other travels in small rows:

1. each segment sends digests of its distinct rows; the earliest segment of each
   owns it, all others hold duplicates;
2. each segment gives the 16 cheapest costs from every state to every state;
3. in one pass backwards these tell what remains to be paid behind each segment;
4. each segment then searches from all four states, independently;
5. in one pass forwards the states, hence the scripts, are chosen and the repaired
   rows hashed. That pass streams a conversation's text through one task, since a
   SHA-256 is sequential by definition; it holds one segment at a time.

Edge cases: NULL roles and texts are one space; a NULL conversation is a conversation,
NULL turns come first and do not count for gaps, nor do turns that are no whole number.
Rows of one turn go by role and a hash of the text. Repeated rows are duplicates. Roles
are judged by their first letter; a row with another one can be reroled or deleted. A
conversation whose rows are all dropped has zeros and an empty audit. Empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.llm import audits
from lintmill.llm.turns import Segment, in_order, segments, streamed
from lintmill.session import materialize

SPACE = " \t\n\x0b\x0c\r"
LONG = T.LongType()
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = [*[T.StructField(c, LONG) for c in COUNTS], T.StructField("audit", T.StringType()),
          T.StructField("repaired_sha256", T.StringType())]
#: What one segment tells the others.
PIECE = [T.StructField("at", LONG), T.StructField("whole", T.BooleanType()),
         T.StructField("first", LONG), T.StructField("last", LONG), T.StructField("distinct", LONG), T.StructField("codes", T.BinaryType()), T.StructField("keys", T.ArrayType(T.BinaryType())),
         T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType()))]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the rows as the remainder of their key's crc32 damages them.

    A dropped row stays as one of no copies, so its conversation is not lost.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    keyed = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn"), text_of("role").alias("role"), text_of("text").alias("text"), damage.alias("d"))
    text = F.when(F.col("d").isin(0, 1), "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return keyed.select(
        "conv", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).alias("copies"),
    )


def _code(role: str, text: str) -> int:
    """A row's role and what is wrong with it alone."""
    kept = text.rstrip(SPACE)
    fault = audits.BLANK if not kept else 0 if kept[-1] in ".!?" else audits.TRUNCATED
    return audits.initial(role) | fault


def _with_duplicates(codes: bytes, repeated: list[bool]) -> bytes:
    """Blank comes before duplicate, duplicate before truncated."""
    return bytes(
        c if not again or c & audits.BLANK else c & audits.ROLE | audits.DUPLICATE for c, again in zip(codes, repeated, strict=True))


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((audits.SYSTEM, audits.USER), (audits.USER, audits.ASSISTANT), (audits.ASSISTANT, audits.USER))


def _counts(codes: bytes) -> list[int]:
    """Blank, duplicate and truncated rows, and neighbours out of order."""
    of = [sum(1 for c in codes if c & bit) for bit in (audits.BLANK, audits.DUPLICATE, audits.TRUNCATED)]
    role = [c & audits.ROLE for c in codes]
    return [*of, sum(1 for a, b in zip(role, role[1:]) if not _legal(a, b))]


def _expanded(segment: Segment) -> tuple[list[tuple[str, str]], list[int]]:
    """The rows themselves, and the known turns in ascending order."""
    rows, turns = [], []
    for turn, role, text, copies in segment.rows:
        rows.extend([(role, text)] * copies)
        if copies and turn is not None and (not turns or turns[-1] != turn):
            turns.append(turn)
    return rows, turns


def _repeated(keys: list) -> list[bool]:
    seen, out = set(), []
    for key in keys:
        out.append(key in seen)
        seen.add(key)
    return out


def _finished(rows: list[tuple[str, str]], turns: list[int]) -> list:
    codes = _with_duplicates(bytes(_code(*r) for r in rows), _repeated(rows))
    cost, audit, _ = audits.cheapest(codes)
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    text = "\n".join(audits.repaired(rows, audit))
    return [gaps, *_counts(codes), cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()]


def _table(found: list[list], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)
    columns = list(zip(*found, strict=True)) if found else [[] for _ in kind]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def _in_batches(found: Iterator[tuple[int, list]], schema: T.StructType, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes, as batches of bounded size."""
    held, size = [], 0
    for weight, row in found:
        held.append(row)
        size += weight + 200
        if size >= most:
            yield _table(held, schema)
            held, size = [], 0
    yield _table(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as Python values, one segment at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _pieces(rows: DataFrame, limits: dict) -> DataFrame:
    """One row per segment: results where it is a whole conversation, else what ``_joined`` needs."""
    turn = rows.withColumn("turn", F.expr("try_cast(turn as long)"))
    schema = T.StructType([rows.schema["conv"], *PIECE, *RESULT])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        for s in segments(batches, ["conv", "turn", "role", "text", "copies"], lambda r: len(r[3]), **limits):
            rows, turns = _expanded(s)
            if s.whole:
                done = _finished(rows, turns)
                yield len(done[-2]), [s.conv, s.at, True, *[None] * 7, *done]
                continue
            keys = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for r, t in rows]
            stats = [turns[0], turns[-1], len(turns)] if turns else [None, None, 0]
            yield sum(len(t) + 32 for _, t in rows), [
                s.conv, s.at, False, *stats, bytes(_code(*r) for r in rows), keys,
                [r for r, _ in rows], [t for _, t in rows], *[None] * 8]

    return turn.mapInArrow(lambda batches: _in_batches(cut(batches), schema), schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """Results of the conversations that lie in more than one segment, or may do so."""
    conv = pieces.schema["conv"]
    distinct = pieces.select("conv", "at", F.explode(F.array_distinct("keys")).alias("key"))
    owned = distinct.groupBy("conv", "key").agg(F.min("at").alias("at")).groupBy("at").agg(F.collect_list("key").alias("owned"))

    marked_as = T.StructType([conv, T.StructField("at", LONG), T.StructField("codes", T.BinaryType()),
                              T.StructField("costs", T.ArrayType(LONG))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        for r in _rows(batches):
            own = set(r["owned"] or [])
            again = [dup or key not in own for dup, key in zip(_repeated(r["keys"]), r["keys"], strict=True)]
            codes = _with_duplicates(r["codes"], again)
            yield len(codes), [r["conv"], r["at"], codes, audits.costs(codes)]

    marked = pieces.select("conv", "at", "codes", "keys").join(owned, "at", "left").mapInArrow(
        lambda batches: _in_batches(mark(batches), marked_as), marked_as)

    ended_as = T.StructType([*marked_as.fields[:3], T.StructField("ends", T.ArrayType(LONG))])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        conv_, ends = (), None
        for r in _rows(batches):
            last = (r["conv"],) != conv_
            if last:
                conv_, ends = (r["conv"],), [cost for cost, _ in audits.ENDS]
            yield len(r["codes"]), [r["conv"], r["at"], r["codes"], None if last else ends]
            ends = audits.ends_before(r["costs"], ends)

    ended = streamed(marked, [F.col("at").desc()], lambda batches: _in_batches(end(batches), ended_as), ended_as)

    searched_as = T.StructType([
        *marked_as.fields[:3], T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("states", T.ArrayType(LONG)),
        T.StructField("paid", T.ArrayType(LONG))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        for r in _rows(batches):
            found = [audits.cheapest(r["codes"], start, r["ends"]) for start in range(4)]
            paid, scripts, states = map(list, zip(*found, strict=True))
            yield 5 * len(r["codes"]), [r["conv"], r["at"], r["codes"], scripts, states, paid]

    searched = ended.repartition("at").mapInArrow(lambda batches: _in_batches(search(batches), searched_as), searched_as)

    # Scripts and texts of a segment meet in order, the scripts first.
    narrow = ["first", "last", "distinct", "roles", "texts"]
    both = searched.withColumn("kind", F.lit(0)).unionByName(
        pieces.select("conv", "at", *narrow, F.lit(1).alias("kind")), allowMissingColumns=True)
    result_as = T.StructType([conv, *RESULT])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        run: _Run | None = None
        for r in _rows(batches):
            if r["kind"] == 0:
                if run is None or run.conv != r["conv"]:
                    if run is not None:
                        yield run.size(), run.result()
                    run = _Run(r["conv"])
                run.take_script(r)
            else:
                run.take_rows(r)
        if run is not None:
            yield run.size(), run.result()

    return streamed(both, ["at", "kind"], lambda batches: _in_batches(finish(batches), result_as), result_as)


class _Run:
    """One conversation, a segment at a time."""

    def __init__(self, conv: object):
        self.conv, self.state, self.next, self.role = conv, 0, 0, None
        self.counts, self.cost, self.audit, self.audits = [0] * 4, 0, "", []
        self.first = self.last = None  # known turns
        self.distinct, self.hash, self.empty = 0, hashlib.sha256(), True

    def take_script(self, r: dict) -> None:
        codes = r["codes"]
        self.audit = r["audits"][self.state]
        self.audits.append(self.audit)
        self.cost += r["paid"][self.state]
        self.next = r["states"][self.state]
        self.counts = [a + b for a, b in zip(self.counts, _counts(codes), strict=True)]
        if codes:
            if self.role is not None and not _legal(self.role, codes[0] & audits.ROLE):
                self.counts[3] += 1
            self.role = codes[-1] & audits.ROLE

    def take_rows(self, r: dict) -> None:
        for line in audits.repaired(list(zip(r["roles"], r["texts"], strict=True)), self.audit, self.state):
            self.hash.update(("" if self.empty else "\n").encode() + line.encode("utf-8", "surrogatepass"))
            self.empty = False
        self.state = self.next
        if r["first"] is not None:
            self.distinct += r["distinct"] - (self.last == r["first"])
            self.first, self.last = r["first"] if self.first is None else self.first, r["last"]

    def size(self) -> int:
        return sum(map(len, self.audits))

    def result(self) -> list:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return [self.conv, gaps, *self.counts, self.cost, "".join(self.audits), self.hash.hexdigest()]


def repair(conversations: DataFrame, **limits) -> DataFrame:
    """Faults, audit and digest of the repaired rows of every conversation, after ``damaged``."""
    pieces = materialize(_pieces(in_order(damaged(conversations)), limits), "pieces")
    results = [f.name for f in RESULT]
    done = pieces.filter("whole").select("conv", *results)
    joined = _joined(pieces.filter("not whole")).select("conv", *results)
    return done.unionByName(joined).withColumnRenamed("conv", "conv_id")
