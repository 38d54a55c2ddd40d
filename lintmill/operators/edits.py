"""Ordered edits of one file: an order-maintenance list of lines, and where each code occurs.

Lines are linked in order and carry labels that ascend along the links, so two lines
are compared without counting. A new line takes the label in the middle between its
neighbours; where none is free, the smallest run of labels that is sparse enough is
spread evenly, which costs O(log n) labels an insertion on average. Each code has a heap
of the lines that hold it, so an edit finds its line, and leaves it, in O(log n), however
long the file is. Spreading keeps the order, so heaps stay heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

APART = 1 << 30  # labels of lines as they are read
CROWD = 1.5      # a run of 2**k labels may hold (2 / CROWD)**k lines


class Line:
    __slots__ = ("label", "before", "after", "number", "text", "codes", "edited")

    def __init__(self, number: int, text: str | None, codes: frozenset[str], edited: bool = False):
        self.label, self.before, self.after = 0, None, None
        self.number, self.text, self.codes, self.edited = number, text, codes, edited

    def __lt__(self, other: Line) -> bool:
        return self.label < other.label


class Lines:
    """Lines of one file in order, under edits that each go to the first line holding a code."""

    def __init__(self) -> None:
        self.first: Line | None = None
        self.last: Line | None = None
        self.holding: dict[str, list[Line]] = {}

    def append(self, number: int, text: str, codes: frozenset[str]) -> None:
        line = Line(number, text, codes)
        self._link(line, self.last, None)
        for code in codes:
            self.holding.setdefault(code, []).append(line)  # ascending, so a heap

    def edit(self, kind: str, code: str, text: str | None, codes: frozenset[str]) -> bool:
        """Whether a line holds the code. ``codes`` are those that ``text`` holds."""
        heap = self.holding.get(code, [])
        while heap and code not in heap[0].codes:
            heapq.heappop(heap)  # deleted, or another text by now
        if not heap:
            return False
        line = heap[0]
        if kind == "insert":
            new = Line(line.number, text, codes, edited=True)
            self._link(new, line.before, line)
            self._holds(new, codes)
        else:
            known = line.codes
            line.text, line.edited = (None if kind == "delete" else text), True
            line.codes = frozenset() if kind == "delete" else codes
            self._holds(line, line.codes - known)
        return True

    def __iter__(self) -> Iterator[Line]:
        """All lines, deleted ones with the text None."""
        line = self.first
        while line is not None:
            yield line
            line = line.after

    def _holds(self, line: Line, codes: frozenset[str]) -> None:
        for code in codes:
            heapq.heappush(self.holding.setdefault(code, []), line)

    def _link(self, line: Line, before: Line | None, after: Line | None) -> None:
        if after is not None and after.label - (before.label if before else 0) < 2:
            self._spread(after)
        low = before.label if before else 0
        line.label = low + APART if after is None else (low + after.label) // 2
        line.before, line.after = before, after
        if before is None:
            self.first = line
        else:
            before.after = line
        if after is None:
            self.last = line
        else:
            after.before = line

    def _spread(self, line: Line) -> None:
        """Spread the labels around a line over the smallest sparse run that holds it."""
        first, last, count, bits = line, line, 1, 1
        while count + 1 > (2 / CROWD) ** bits:
            bits += 1
            low = line.label >> bits << bits
            while first.before is not None and first.before.label >= low:
                first, count = first.before, count + 1
            while last.after is not None and last.after.label < low + (1 << bits):
                last, count = last.after, count + 1
        step, one = (1 << bits) // (count + 1), first
        for n in range(1, count + 1):
            one.label, one = low + n * step, one.after
