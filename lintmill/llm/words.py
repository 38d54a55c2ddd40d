"""Words of whole columns of texts, and 64-bit names for words and word sequences.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Everything works on the
bytes of a whole Arrow column, without a Python step per word.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
LONG_WORD = 4096  # bytes; longer words are named by a digest

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass
class Words:
    """Words of n documents; those of document d are first[d] up to first[d + 1]."""

    data: np.ndarray   # bytes of all texts
    first: np.ndarray
    start: np.ndarray  # byte range of each word
    end: np.ndarray
    name: np.ndarray   # 64-bit name of each word

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a fresh uint64 array over all bits, in place."""
    x ^= x >> np.uint64(32)
    x *= _ODD[2]
    x ^= x >> np.uint64(29)
    x *= _ODD[3]
    x ^= x >> np.uint64(32)
    return x


def join_names(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """Names of pairs, from the names of their halves."""
    return mix(a * _ODD[lane] + b)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes (eight spaces behind), and where each begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    count = len(texts)
    if not count:
        return np.full(8, 32, np.uint8), np.zeros(1, np.int64)
    _, places, held = texts.buffers()
    offsets = np.frombuffer(places, np.int64, count + 1, texts.offset * 8)
    size = int(offsets[-1] - offsets[0])
    data = np.full(size + 8, 32, np.uint8)
    if size:
        data[:size] = np.frombuffer(held, np.uint8, size, int(offsets[0]))
    return data, offsets - offsets[0]


def split_words(texts: pa.Array | pa.ChunkedArray, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words of each text; ``lower`` turns A-Z to a-z first. NULL has none.

    ``space`` tells for each byte whether it stands between words.
    """
    data, offsets = text_bytes(texts)
    size = len(data) - 8
    if lower:
        data = LOWER[data]
    inside = ~space[data[:size]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]  # words end where a document ends
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, np.searchsorted(start, offsets), start, end, _names(data, start, end))


def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    name = mix((eight[start] & MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * _ODD[1])
    more, at = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while more.size:
        rest = eight[start[more] + at] & MASK[np.minimum(length[more] - at, 8)]
        name[more] = join_names(name[more], rest)
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest()
        name[i] = np.frombuffer(digest, "<u8")[0]
    return name


BASES = [0x5851F42D4C957F2D, 0xD1342543DE82EF95]  # odd, 5 modulo 8


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def grams(name: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Names of all sequences of ``n`` neighbours: a polynomial of their names."""
    count = len(name) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    base = BASES[lane]
    total = np.zeros(len(name) + 1, np.uint64)
    np.cumsum(name * _powers(base, len(name)), out=total[1:])
    out = total[n:] - total[:-n]
    out *= _powers(pow(base, -1, 1 << 64), count)
    return mix(out + np.uint64(n))


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Word positions at which ``n`` words of one document begin."""
    room = np.maximum(np.diff(first) - n + 1, 0)
    total = int(room.sum())
    shift = np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    return np.arange(total) + shift
