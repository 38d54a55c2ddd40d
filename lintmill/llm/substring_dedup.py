"""Removal of repeated word sequences by recompression.

Texts are parsed by rounds of recompression: runs of equal words get a name, then
in every round each pair (left symbol, right symbol) gets one, where a bit of the
symbol's own name says on which side it stands. Names are hashes of what they
stand for, so all tasks give equal substrings equal names without asking, and
only the symbols at the edges of a substring depend on what surrounds it. The
edges are tracked per window: the symbols that every occurrence of a window must
share are known from the window alone.

1. Blocks exchange the symbols of the last round; those seen once end all windows
   that hold them.
2. Windows whose certain symbols are all shared are verified by a 96-bit name of
   their words, exchanged in the same way.
3. Each block removes the words of its repeated windows.

Edge cases: NULL and empty texts have no words and become ''. Repeated rows are
occurrences like any other. Other columns are kept; one that is named like a
result column is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm import blocks as B
from lintmill.llm import words as W
from lintmill.session import materialize

WINDOW = 35
ROUNDS = 6


def window_symbols(words: W.Words, window: int, rounds: int):
    """Parse; returns window starts, symbols, and the certain symbols of each window.

    A window's certain symbols are low..high; ``vague`` marks windows without any.
    """
    starts = W.gram_starts(words.first, window)
    name = words.name
    count = len(name)
    if not len(starts):
        none = np.zeros(0, np.int32)
        return starts, np.zeros(0, np.uint64), none, none, np.zeros(0, bool)
    head = np.zeros(count + 1, bool)
    head[words.first[:-1]] = True
    head = head[:count]
    new = np.ones(count, bool)
    new[1:] = (name[1:] != name[:-1]) | head[1:]
    begin = np.flatnonzero(new)
    run_of = np.cumsum(new, dtype=np.int32)  # from 1: symbol 0 stands before all others
    length = np.diff(np.append(begin, count))
    symbol = name[begin]
    longer = np.flatnonzero(length > 1)
    symbol[longer] = W.join_names(symbol[longer], length[longer].astype(np.uint64), 1)
    head = head[begin]
    low = run_of[starts] + np.int32(1)  # the first and last run may go on outside
    high = run_of[starts + (window - 1)] - np.int32(1)
    for r in range(rounds):
        right = (symbol >> np.uint64(8 + 7 * r)).astype(np.int8) & np.int8(1)
        side = np.zeros(len(symbol) + 2, np.int8)
        side[1:-1] = right
        low += side[low]  # a right symbol may belong to a left one outside
        side[1:-1] = 1 - right
        high -= side[high]
        pair = right[1:] > right[:-1]
        pair &= ~head[1:]
        kept = np.ones(len(symbol), bool)
        np.logical_not(pair, out=kept[1:])
        place = np.zeros(len(symbol) + 2, np.int32)
        np.cumsum(kept, out=place[1:-1])
        place[-1] = place[-2] + 1
        lefts = np.flatnonzero(pair)
        symbol[lefts] = W.join_names(symbol[lefts], symbol[lefts + 1], 1)
        low, high = place[low], place[high]
        symbol, head = symbol[kept], head[kept]
    return starts, symbol, low - np.int32(1), high - np.int32(1), low > high


def _distinct(values: np.ndarray):
    """Sorted distinct values, which of them occur more than once, each one's place."""
    found, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    return found, counts > 1, place


class _Block:
    """One block's parse, redone in each step from its texts."""

    def __init__(self, table: pa.Table, window: int, rounds: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.number = table["block"][0].as_py()
        self.words = W.split_words(table["text"])
        self.starts, symbol, self.low, self.high, self.vague = window_symbols(self.words, window, rounds)
        sure, size = ~self.vague, len(symbol) + 1
        used = np.bincount(self.low[sure], minlength=size) - np.bincount(self.high[sure] + 1, minlength=size)
        self.used = np.flatnonzero(np.cumsum(used)[:-1])
        self.size = len(symbol)
        self.names, self.twice, self.place = _distinct(symbol[self.used])

    def send_symbols(self) -> pa.Table:
        return B.sent_rows(self.number, self.names, [self.names.astype(np.uint32)], self.buckets)

    def candidates(self, answers: list[bytes]) -> None:
        """Windows whose certain symbols all occur elsewhere too."""
        shared = B.flags_of(self.names, self.buckets, answers) | self.twice
        once = np.zeros(self.size, np.int64)
        once[self.used] = ~shared[self.place]
        before = np.append(0, np.cumsum(once))
        found = self.vague | (before[np.maximum(self.high + 1, self.low)] == before[self.low])
        self.starts = self.starts[found]
        first, second = (W.grams(self.words.name, self.window, lane)[self.starts] for lane in (0, 1))
        order = np.lexsort((second.astype(np.uint32), first))
        first, second = first[order], second.astype(np.uint32)[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        place = np.empty(len(first), np.int64)
        place[order] = np.cumsum(new) - 1
        self.place = place
        self.keys, self.low_keys = first[new], second[new]
        self.multiple = np.bincount(place, minlength=len(self.keys)) > 1

    def send_windows(self) -> pa.Table:
        pairs = np.empty(len(self.keys), "<u8,<u4")
        pairs["f0"], pairs["f1"] = self.keys, self.low_keys
        return B.sent_rows(self.number, self.keys, [pairs], self.buckets)

    def kept_texts(self, answers: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        """Words removed and remaining text of each document."""
        words = self.words
        repeated = B.flags_of(self.keys, self.buckets, answers) | self.multiple
        hits = self.starts[repeated[self.place]]
        size = len(words.name) + 1
        marks = np.bincount(hits, minlength=size) - np.bincount(hits + self.window, minlength=size)
        gone = np.cumsum(marks)[:-1] > 0
        removed = np.diff(np.append(0, np.cumsum(gone))[words.first])
        return removed, kept_text(words, ~gone)


def kept_text(words: W.Words, keep: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by single spaces."""
    docs = len(words.first) - 1
    doc = words.doc_of_word()[keep]
    start, end = words.start[keep], words.end[keep]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    step = np.zeros(len(words.data) + 1, np.int8)
    step[start] = 1
    step[end] -= 1
    taken = np.cumsum(step, dtype=np.int8)[:-1].astype(bool)
    behind = end[~last]  # between two words of a document there is a space
    data = words.data.copy()
    data[behind] = 32
    taken[behind] = True
    size = np.bincount(doc, weights=end - start + ~last, minlength=docs)
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(
        docs, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[taken].tobytes())
    )


def _wide_flags(blobs: list[bytes]) -> list[bytes]:
    """Which 96-bit keys more than one block has sent, a bit each."""
    counts = [len(b) // 12 for b in blobs]
    keys = np.concatenate([np.frombuffer(b, "<u8,<u4") for b in blobs])
    order = np.lexsort((keys["f1"], keys["f0"]))
    first, second = keys["f0"][order], keys["f1"][order]
    same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(counts)[:-1])]


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Documents without the words covered by a window that also starts elsewhere.

    ``text`` becomes the kept words joined by one space; ``n_words`` and
    ``n_removed`` are added.
    """
    made = B.write_blocks(docs, drop=("n_words", "n_removed"))
    buckets, table = made.buckets, made.table
    texts = table.select("block", "text")

    def symbols(key, t):
        return _Block(t, window, rounds, buckets).send_symbols()

    shared = materialize(
        B.exchange(texts.groupBy("block").applyInArrow(symbols, B.SENT), B.shared_flags("<u4", 4)), "symbols"
    )

    def windows(key, t, answers):
        if not t.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        block = _Block(t, window, rounds, buckets)
        block.candidates(B.ordered(answers))
        return block.send_windows()

    sent = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(windows, B.SENT)
    repeated = B.exchange(sent, _wide_flags)
    answers = shared.withColumn("step", F.lit(1)).unionByName(repeated.withColumn("step", F.lit(2)))

    def remove(key, t, found):
        steps = found["step"].to_numpy()
        block = _Block(t, window, rounds, buckets)
        block.candidates(B.ordered(found.filter(pa.array(steps == 1))))
        removed, text = block.kept_texts(B.ordered(found.filter(pa.array(steps == 2))))
        return pa.table({
            "row": t["row"], "text": text.cast(pa.string()), "n_words": pa.array(np.diff(block.words.first)),
            "n_removed": pa.array(removed),
        })

    out = table.drop("uid").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        remove, B.with_row(table, "text string, n_words long, n_removed long")
    )
    return out.select(*B.row_columns(out), "text", "n_words", "n_removed")
