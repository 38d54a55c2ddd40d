"""Packing of token sequences by non-negative least squares.

A document's whole windows are sequences of their own. What is left of it is one
of window - 1 lengths, so the job is a histogram of bounded size: combinations of
two and three lengths that fill a window exactly are enumerated, their repeat
counts solve min |A x - h| with x >= 0 against the histogram h, are rounded and
limited to what there is, and what no combination takes is packed greedily, end to
end, and cut where a window is full. Only the last window can be short; it is cut
into powers of two, which need no padding.

Which sequence and offset a piece gets follows from its length and its rank among
the pieces of that length. A rank is counted within a part of the input and begins
where the parts before it end, so a length that a third of all documents have is spread
like any other, and no text or id is moved to be ranked.

Edge cases: NULL and empty texts are the end token alone. Repeated rows are packed
each. An added token's string in a text is that token, as the tokenizer has it. Empty
tables give no pieces. The documents' other columns stay in the result; those named
like results are replaced.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.llm.blocks import row_columns, write_bucketed
from lintmill.session import materialize

WINDOW = 2048
TOKENIZED = ["doc_tokens", "rest", "nth", "first_sequence"]
PASSES = 12           # of the least-squares solver
PACKED = 1 << 62      # sequences of combinations and rests count from here

#: How a byte-level tokenizer cuts texts; no longer run of spaces is given to the fast library.
_PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_LONG_GAP = r"\s{4096}"


def _byte_of() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: itself if it prints, else 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class _Encoder:
    """Ids as packed bytes, those of the tokenizer's file.

    A plain byte-level BPE is run by a faster library with the same vocabulary. Texts
    that hold an added token's string or a very long gap, and all texts of other
    tokenizers, go through the tokenizer itself.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = np.dtype(f"<u{_width(spec)}")
        self.end = np.array([end_id], self.kind).tobytes()
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        added = [t["content"] for t in spec["added_tokens"]]
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        plain = (
            model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec["normalizer"] is None and not model.get("dropout") and not model.get("ignore_merges")
            and None not in merged and merged == sorted(merged)
        )
        self.odd = re.compile("|".join([_LONG_GAP, *map(re.escape, added)]))
        if not plain:
            return None
        import tiktoken

        byte = _byte_of()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added}
        return tiktoken.Encoding("vocabulary", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [self.end] * len(texts)
        whole = []
        for i, text in enumerate(texts):
            if text and self.fast is not None and not self.odd.search(text):
                out[i] = np.array(self.fast.encode_ordinary(text), self.kind).tobytes() + self.end
            elif text:
                whole.append(i)
        found = self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        for i, ids in zip(whole, found, strict=True):
            out[i] = np.array(ids.ids, self.kind).tobytes() + self.end
        return out


@functools.cache
def _encoder(path: str, end_id: int) -> _Encoder:
    return _Encoder(path, end_id)


def token_width(path: str) -> int:
    """Bytes of one id in the packed column.

    Read off the tokenizer's file: the driver asks for it too, and a tokenizer once
    built there would take its memory for good.
    """
    with open(path, encoding="utf-8") as file:
        return _width(json.load(file))


def _width(spec: dict) -> int:
    vocabulary = spec["model"]["vocab"]
    pieces = set(vocabulary) if isinstance(vocabulary, dict) else {piece for piece, _ in vocabulary}
    return 2 if len(pieces | {t["content"] for t in spec["added_tokens"]}) <= 1 << 16 else 4


def tokenize(docs: DataFrame, path: str, text: str = "text", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Documents as (part, row, ids, doc_tokens, rest, nth, first_sequence); ids are packed little-endian integers.

    ``part`` is the partition of the input. ``rest`` is what a document has beyond whole
    windows, ``nth`` counts the earlier documents of its part with as long a rest, and
    ``first_sequence`` numbers whole windows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    keyed = docs.select(
        F.spark_partition_id().cast("long").alias("part"),
        F.struct(*others, F.lit(None).cast("boolean").alias("llm_end")).alias("row"), F.col(f"`{text}`").alias("text"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, seen = _encoder(path, end_id), 0, np.zeros(window, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encoder.encode(part["text"].to_pylist())
                size = np.array([len(x) for x in ids], np.int64) // encoder.kind.itemsize
                full, rest, nth = size // window, size % window, np.zeros(len(size), np.int64)
                for i, r in enumerate(rest.tolist()):
                    nth[i] = seen[r]
                    seen[r] += 1
                first = (part["part"].to_numpy() << 33) + before + np.cumsum(full) - full
                before += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [part["part"], part["row"], pa.array(ids, pa.binary()), *map(pa.array, (size, rest, nth, first))],
                    ["part", "row", "ids", *TOKENIZED],
                )

    schema = T.StructType([
        *keyed.schema.fields[:2], T.StructField("ids", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in TOKENIZED]])
    return keyed.mapInArrow(encode, schema)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All ways to fill a window exactly with two, or with three, of the lengths (0: unused)."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    pairs = np.array([(0, a, window - a) for a in lengths if a <= window - a and have[window - a]], np.int64)
    triples = []
    for a in lengths:
        b = lengths[(lengths >= a) & (window - a - lengths >= lengths)]
        b = b[have[window - a - b]]
        triples.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate([pairs.reshape(-1, 3), *triples]) if triples else pairs.reshape(-1, 3)


def solve(columns: np.ndarray, histogram: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """x >= 0 that minimises |A x - h|, one coordinate after the other.

    A column of A counts how often each length occurs in the combination. After
    the first pass only columns in use are visited, and all of them again at the end.
    """
    rest = histogram.astype(float).tolist()
    x = [0.0] * len(columns)
    plain = columns.tolist()
    visit = range(len(plain))
    for turn in range(passes):
        for c in visit:
            parts = [p for p in plain[c] if p]
            weight = sum(parts.count(p) for p in parts)
            step = max(sum(rest[p] for p in parts) / weight, -x[c])
            if step:
                x[c] += step
                for p in parts:
                    rest[p] -= step
        visit = [c for c in range(len(plain)) if x[c] > 0] if turn < passes - 2 else range(len(plain))
    return np.array(x)


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple], np.ndarray, int]:
    """Slots of every length in repeated combinations; pieces taken per length; sequences used.

    A slot is (length, from rank, to rank, first sequence, uses per sequence, offsets).
    """
    lengths = np.flatnonzero(histogram)
    pairs_left = histogram - np.minimum(histogram, histogram[::-1])  # length a meets window - a
    columns = combinations(lengths, window)
    if len(columns):
        spare = pairs_left > 0
        kept = (columns[:, 0] == 0) | spare[columns].all(1)
        columns = columns[kept]
    left, slots, sequence = histogram.copy(), [], 0
    taken = np.zeros_like(histogram)
    counts = np.rint(solve(columns, histogram)) if len(columns) else np.zeros(0)
    for c in np.argsort(-counts, kind="stable"):
        parts = [int(p) for p in columns[c] if p]
        uses = {p: parts.count(p) for p in parts}
        repeats = int(min([counts[c], *(left[p] // n for p, n in uses.items())]))
        if repeats <= 0:
            continue
        offsets, at = {p: [] for p in uses}, 0
        for p in parts:
            offsets[p].append(at)
            at += p
        for p, n in uses.items():
            first = int(taken[p])
            slots.append((p, first, first + repeats * n, sequence, n, offsets[p]))
            taken[p] += repeats * n
            left[p] -= repeats * n
        sequence += repeats
    return slots, taken, sequence


def powers(length: int) -> list[int]:
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


SLOTS = "array<struct<low:long,high:long,sequence:long,uses:long,offsets:array<long>>>"


def pack(tokens: DataFrame, width: int, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents, each with its sequence and offset.

    ``tokens`` as from ``tokenize``. Returns the documents' columns and start,
    length, ids, doc_tokens, sequence_id and offset. The ids are written once and stay
    where they are: what each part of them needs is one row, the ranks at which its
    rests begin.
    """
    held = write_bucketed(tokens, "part")
    counts = materialize(held.filter("rest > 0").groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n")), "rests")
    histogram = np.zeros(window + 1, np.int64)
    for r, n in counts.groupBy("rest").agg(F.sum("n")).collect():  # at most window - 1 rows
        histogram[r] = n
    slots, taken, sequences = plan(histogram, window)
    sizes = np.arange(window + 1) * (histogram - taken)
    base = np.cumsum(sizes[::-1])[::-1] - sizes  # long rests first
    by_length: dict[int, list] = {int(r): [] for r in np.flatnonzero(histogram)}
    for r, *slot in slots:
        by_length[r].append(tuple(slot))
    lookup = tokens.sparkSession.createDataFrame(
        [(r, int(taken[r]), int(base[r]), s) for r, s in by_length.items()], f"rest long, taken long, base long, slots {SLOTS}")
    earlier = F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("part", "rest", F.coalesce(earlier, F.lit(0).cast("long")).alias("before")).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("rest", "before"))).alias("before"))  # at most window - 1 entries
    ranked = held.join(before, "part", "left").withColumn("rank", F.expr("try_element_at(before, rest) + nth"))
    pieces = ranked.join(F.broadcast(lookup), "rest", "left").withColumn(  # at most window - 1 rows
        "piece", F.explode(_pieces(sequences, int(sizes.sum()), window)))
    cut = F.substring("ids", (F.col("piece.start") * width + 1).cast("int"), (F.col("piece.length") * width).cast("int"))
    new = {"start": F.col("piece.start"), "length": F.col("piece.length"), "ids": cut, "doc_tokens": F.col("doc_tokens"),
           "sequence_id": F.col("piece.sequence_id"), "offset": F.col("piece.offset")}
    return pieces.select(*row_columns(pieces, without=set(new)), *[c.alias(n) for n, c in new.items()])


def _pieces(sequences: int, total: int, window: int) -> Column:
    """Array of a document's pieces: whole windows, then its rest in a combination or end to end with others."""
    last = total // window * window  # the last, short window holds powers of two
    ends = [last, *(last + np.cumsum(powers(total - last))).tolist()]
    bounds = f"array({', '.join(f'{int(e)}L' for e in ends)})"
    piece = lambda start, length, sequence, offset: (
        f"named_struct('start', {start}, 'length', {length}, 'sequence_id', {sequence}, 'offset', {offset})")
    whole = f"transform(sequence(0L, doc_tokens div {window} - 1), k -> {piece(f'k * {window}L', f'{window}L', 'first_sequence + k', '0L')})"
    slot = "filter(slots, s -> rank >= s.low and rank < s.high)"
    packed = f"transform({slot}, s -> " + piece(
        "doc_tokens - rest", "rest", f"{PACKED}L + s.sequence + (rank - s.low) div s.uses", "s.offsets[cast((rank - s.low) % s.uses as int)]") + ")"
    at = "(base + (rank - taken) * rest)"
    end = f"({at} + rest)"
    cuts = (f"array_sort(array_distinct(concat(array({at}), filter(array(({at} div {window} + 1) * {window}L), c -> c < {end}), "
            f"filter({bounds}, c -> c > {at} and c < {end}))))")
    held = f"filter({bounds}, e -> e <= c)"
    loose = f"transform({cuts}, (c, i) -> " + piece(
        f"c - {at} + doc_tokens - rest", f"coalesce(try_element_at({cuts}, i + 2), {end}) - c",
        f"{PACKED + sequences}L + if(c < {last}, c div {window}, {last // window}L + size({held}) - 1)",
        f"c - if(c < {last}, c div {window} * {window}L, array_max({held}))") + ")"
    none = f"filter(array({piece('0L', '0L', '0L', '0L')}), p -> false)"
    return F.expr(
        f"concat(if(doc_tokens >= {window}, {whole}, {none}), "
        f"case when rest = 0 then {none} when rank < taken then {packed} else {loose} end)")
