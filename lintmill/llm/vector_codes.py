"""Product codes of vectors: every part of a vector becomes the index of its nearest codebook entry.

Components are scaled to integers, so all sums and distances are exact and reruns
agree. A codebook starts as the parts of the first vectors by id; every round
assigns all parts and replaces each entry by the floor of the mean of its parts.
Vectors are assigned where they lie: a task sends one partial sum per entry it
uses, Spark adds those up, and only the codebooks (entries x components) pass the
driver. Labels share their vectors' errors through one aggregate.

The nearest entry is found by slices. The coordinates of all entries are sorted in
every dimension, and each place in that order carries the uint64 mask of the entries
before it. The mask of a range of coordinates is then the difference of two prefixes,
and the AND over all dimensions leaves the entries inside a box around the part. A
first radius is what most of a batch's parts need; a part whose best candidate is
no nearer than the box reaches (or whose box is empty) is sliced again, with the
distance found or twice the radius. Every entry within a distance lies in the box
of that radius, so what is left holds all nearest entries, and the lowest index wins.

Edge cases: rows whose vector is NULL or holds a null or non-finite component are
dropped. Shorter vectors count as filled up with zeros to the longest, and all to a
multiple of the parts. NULL ids come last and are coded like others; vectors of
equal ids go by their components. With fewer vectors than entries the codebooks are
shorter. Components stop at 2**52 after scaling, errors and their sums at the
largest long; where integers are too large for exact doubles, distances are taken
with Python's integers. NULL labels are one label. Empty tables give no rows. Columns
besides id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.operators.skew import spread_join
from lintmill.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 52          # components stop here
LONGEST = (1 << 63) - 1  # errors stop here
CHUNK = 1024             # vectors sliced together
PROBED = 64              # parts of a chunk that the first radius is taken from
FEW_LABELS = 1 << 16     # up to so many label totals are broadcast


class Slices:
    """Sorted coordinates of one part's entries with the masks of the entries before them."""

    def __init__(self, entries: np.ndarray):
        self.count, self.dims = entries.shape
        self.exact = entries
        self.entries = entries.astype(float)
        # Distances are exact in doubles while their sum stays below 2**53.
        self.widest = math.isqrt((1 << 53) // (4 * max(self.dims, 1)))
        self.narrow = not entries.size or int(np.abs(entries).max()) <= self.widest
        order = np.argsort(self.entries, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.entries.T, order, axis=1)
        words = -(-self.count // 64)
        bits = np.zeros((self.count, words), np.uint64)
        at = np.arange(self.count)
        bits[at, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
        self.before = np.zeros((self.dims, self.count + 1, words), np.uint64)
        for d in range(self.dims):
            self.before[d, 1:] = np.bitwise_or.accumulate(bits[order[d]], axis=0)
        self.all = np.bitwise_or.reduce(bits, axis=0)

    def boxes(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries at most ``radius`` off in every dimension."""
        mask = np.tile(self.all, (len(x), 1))
        for d in range(self.dims):
            low = np.searchsorted(self.sorted[d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            mask &= self.before[d][high] & ~self.before[d][low]
        return mask

    def _best(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry in each mask and its squared distance; infinite if the mask is empty."""
        held = np.unpackbits(mask.view(np.uint8), axis=1, count=self.count, bitorder="little")
        row, entry = np.nonzero(held)
        index, found = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        if len(row):
            off = x[row] - self.entries[entry]
            square = np.einsum("ij,ij->i", off, off)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(square, first)
            found[row[first]] = least
            hit = np.flatnonzero(square == np.repeat(least, np.diff(np.r_[first, len(row)])))
            hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # entries ascend: the lowest index first
            index[row[hit]] = entry[hit]
        return index, found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the entry nearest to each row of integers."""
        wide = np.abs(x).max(axis=1, initial=0) > self.widest if self.narrow else np.ones(len(x), bool)
        index, error = np.zeros(len(x), np.int64), np.zeros(len(x), object if wide.any() else np.int64)
        if wide.any():
            index[wide], error[wide] = self._nearest_wide(x[wide])
        open_ = np.flatnonzero(~wide)
        if not len(open_):
            return index, error
        x = x.astype(float)
        probed = x[open_[:: max(1, len(open_) // PROBED)]]
        least = [np.min(np.einsum("ij,ij->i", self.entries - p, self.entries - p)) for p in probed]
        radius = np.full(len(x), max(1.0, math.ceil(math.sqrt(np.quantile(least, 0.75)))))
        while len(open_):
            at, found = self._best(x[open_], self.boxes(x[open_], radius[open_]))
            sure = found <= radius[open_] ** 2
            done = open_[sure]
            index[done], error[done] = at[sure], found[sure].astype(np.int64)
            again = ~sure
            wider = np.where(np.isinf(found[again]), 2 * radius[open_[again]], np.ceil(np.sqrt(found[again])) + 1)
            open_ = open_[again]
            radius[open_] = wider
        return index, error

    def _nearest_wide(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        index, error = [], np.empty(len(x), object)
        for i, row in enumerate(x.astype(object)):
            square = ((self.exact.astype(object) - row) ** 2).sum(axis=1).tolist() if self.dims else [0] * self.count
            error[i] = min(square)
            index.append(square.index(error[i]))
        return index, error


@dataclass
class Codebooks:
    """``entries`` by part, entry and position."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def integers(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole and finite, and those as integers, filled up to ``width``."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    value = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan), float)
    row = np.repeat(np.arange(len(size)), size)
    good = np.asarray(vectors.is_valid())
    good[row[~np.isfinite(value)]] = False
    place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), width), np.int64)
    kept = good[row]
    out[row[kept], place[kept]] = np.clip(np.floor(value[kept] * scale), -LIMIT, LIMIT).astype(np.int64)
    return good, out[good]


def _assign(slices: list[Slices], x: np.ndarray) -> Iterator[tuple[slice, list, list]]:
    """Per chunk of vectors: the entries and squared distances of every part."""
    width = slices[0].dims
    for at in range(0, len(x), CHUNK):
        rows = slice(at, at + CHUNK)
        found = [s.nearest(x[rows, p * width:(p + 1) * width]) for p, s in enumerate(slices)]
        yield rows, [f[0] for f in found], [f[1] for f in found]


def _first(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks made of the first vectors by id. At most ``entries`` vectors reach the driver."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter(F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False)))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"]
    x = integers(first, width, scale)[1]
    return Codebooks(np.stack(np.split(x, parts, axis=1)), scale)


def _updated(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; unused ones stay."""
    parts, _, dims = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(e) for e in books.entries]
        count = np.zeros(books.entries.shape[:2], np.int64)
        low, high = np.zeros((2, *books.entries.shape), np.int64)  # sums of the lower 32 bits and of the rest
        for batch in batches:
            x = integers(batch["vector"], parts * dims, books.scale)[1]
            for rows, index, _ in _assign(slices, x):
                for p in range(parts):
                    part = x[rows, p * dims:(p + 1) * dims]
                    np.add.at(low[p], index[p], part & 0xFFFFFFFF)
                    np.add.at(high[p], index[p], part >> 32)
                    count[p] += np.bincount(index[p], minlength=count.shape[1])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
             pa.array(low[p, e].tolist(), pa.list_(pa.int64())), pa.array(high[p, e].tolist(), pa.list_(pa.int64()))],
            ["part", "entry", "n", "low", "high"],
        )

    partial = vectors.select("vector").mapInArrow(sums, "part int, entry int, n long, low array<long>, high array<long>")
    total = partial.select("part", "entry", "n", F.posexplode(F.arrays_zip("low", "high")).alias("place", "sums")).groupBy(
        "part", "entry", "place"
    ).agg(F.sum("n").alias("n"), F.sum("sums.low").alias("low"), F.sum("sums.high").alias("high"))
    entries = books.entries.copy()
    for r in total.collect():  # one row per component of the codebooks
        entries[r.part, r.entry, r.place] = ((r.high << 32) + r.low) // r.n
    return Codebooks(entries, books.scale)


def learn(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all vectors."""
    found = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    books = _first(found, parts, entries, scale)
    for _ in range(rounds if books.entries.size else 0):
        books = _updated(found, books)
    return books


def encode(
    vectors: DataFrame, books: Codebooks, id_column: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(id, label) with ``code`` (two hex digits a part), ``error`` and ``label_error``."""
    parts, _, dims = books.entries.shape
    named = vectors.select(F.col(f"`{id_column}`"), F.col(f"`{label}`"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).toDF(
        "id", "label", "vector")
    schema = T.StructType([*named.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(e) for e in books.entries]
        for batch in batches:
            good, x = integers(batch["vector"], parts * dims, books.scale)
            code, error = [], []
            for _, index, square in _assign(slices, x):
                code.extend(bytes(row).hex() for row in np.stack(index, 1).astype(np.uint8).tolist())
                error.extend(min(e, LONGEST) for e in sum(s.astype(object) for s in square).tolist())
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [kept["id"], kept["label"], pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"]
            )

    # A JSON value names every label, NULL too.
    coded = materialize(named.mapInArrow(codes, schema).withColumn("key", F.to_json(F.struct("label"))), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    totals = materialize(coded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), total.alias("label_error")), "labels")
    if totals.count() <= FEW_LABELS:
        joined = coded.join(F.broadcast(totals.drop("n")), "key")  # at most FEW_LABELS rows
    else:
        joined = spread_join(coded, totals.drop("n"), ["key"], "id", totals.select("key", "n"))
    return joined.select(F.col("id").alias(id_column), F.col("label").alias(label), "code", "error", "label_error")


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", **sizes) -> DataFrame:
    """Codes of all vectors and the digest of the codebooks they refer to."""
    books = learn(vectors, id_column, vector, **sizes)
    return encode(vectors, books, id_column, vector, label).withColumn("codebooks_sha256", F.lit(books.digest()))
