"""Approximate nearest neighbours by balanced posting lists.

Largest inner products become smallest distances by one more component,
sqrt(M^2 - |x|^2) with M the largest norm (0 for queries). Centroids come from a
balanced k-means over a bounded sample. Every vector goes to the posting list of
its nearest centroid and, near a boundary, to those of up to COPIES - 1 others
within a distance ratio. The centroids, a bounded number without duplicates, are
searched at every size by a walk over a graph that every task holds: links go both
ways, and a small upper level joins all parts of it. A query reads the lists whose centroids are within a
distance ratio of the nearest, and more where these hold too few vectors.

Equal vectors are one: it keeps its k + 1 smallest ids, which suffice since equal
scores go by smaller id and a query leaves out itself only. Each distinct vector is
searched once, and its result joined back to the ids that ask for it. Lists are cut
into parts of bounded size and the queries of a shard of parts into chunks, for each
of which the shard's vectors are repeated, so no task grows with the input.

Scores are inner products of the original vectors in double precision; within the
lists read, the search is exact.

Edge cases: vectors that are NULL, zero, hold NULL or non-finite components, have
no id or another length than most take no part. Rows with the same id count as
one, with the better score. Equal scores go by smaller id. With fewer candidates
than ``k`` all are returned. Empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintmill.operators.skew import spread_join
from lintmill.session import materialize

K = 20
LIST = 256          # vectors of a list, as far as MAX_LISTS allows
MAX_LISTS = 8192
PER_LIST = 48       # sampled vectors per list: the sample has at most 393,216
COPIES = 4
COPY_RATIO = 1.12   # a copy goes to centroids within this ratio of the nearest distance
READ_RATIO = 1.25   # a query reads lists within this ratio
BEAM = 64           # lists that a graph search returns
DEGREE = 24         # nearest centroids that a centroid is linked with, besides those it is near to
PART = 8192         # vectors of a part of a list
SHARD = 32_768      # vectors, copies counted, that one task searches
CHUNK = 32_768      # queries, about, that one task searches a shard for


@dataclass
class Index:
    """Centroids (with the additional component), their graph and the largest norm.

    A row of the graph holds a centroid's links, then -1. A search enters by the
    hubs, a small upper level.
    """

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    hubs: np.ndarray | None = None

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        spare = np.sqrt(np.maximum(self.norm ** 2 - (vectors ** 2).sum(1), 0))
        return np.concatenate([vectors, spare[:, None]], 1)

    def search(self, points: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids of each point and their distances: a best-first walk.

        Columns that a walk could not fill have an infinite distance.
        """
        count, rows = len(self.centroids), len(points)
        beam = min(beam, count)
        square, length = (self.centroids ** 2).sum(1), (points ** 2).sum(1)
        links = (self.graph >= 0).sum(1)
        start = np.unique(np.linspace(0, count - 1, beam).astype(np.int64)) if self.hubs is None else self.hubs
        best = np.tile(start, (rows, 1))
        far = length[:, None] + square[start] - 2 * points @ self.centroids[start].T
        seen, done = np.zeros((rows, count), bool), np.zeros((rows, count), bool)
        seen[:, start] = True
        each, walking = np.arange(rows)[:, None], np.arange(rows)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            best, far = np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)
            fresh = ~done[walking[:, None], best[walking]] & np.isfinite(far[walking])
            ahead = fresh.any(1)
            walking, pick = walking[ahead], fresh[ahead].argmax(1)
            if not len(walking):
                break
            node = best[walking, pick]
            done[walking, node] = True
            near = self.graph[node, :max(1, int(links[node].max()))]
            new = (near >= 0) & ~seen[walking[:, None], near]
            row, node = walking[np.nonzero(new)[0]], near[new]
            seen[row, node] = True
            place = (np.cumsum(new, axis=1) - 1)[new]
            more = int(new.sum(1).max())
            both = np.concatenate([best, np.zeros((rows, more), best.dtype)], 1)
            far = np.concatenate([far, np.full((rows, more), np.inf)], 1)
            at = best.shape[1] + place
            both[row, at] = node
            far[row, at] = length[row] + square[node] - 2 * np.einsum("nd,nd->n", points[row], self.centroids[node])
            best = both
        return best, np.sqrt(np.maximum(far, 0))


def linked(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The graph over centroids and its hubs; every centroid can be reached from every other.

    Links go both ways: to the DEGREE nearest, between a centroid and its nearest
    hub, and from hub to hub in a ring and to the nearest.
    """
    count = len(centroids)
    square = (centroids ** 2).sum(1)

    def nearest_of(rows: np.ndarray, among: np.ndarray, links: int) -> np.ndarray:
        """(from, to) of each row's nearest others."""
        out, links = [np.zeros((0, 2), np.int64)], min(links, len(among))
        for at in range(0, len(rows), 1024):
            some = rows[at:at + 1024]
            far = square[among] - 2 * centroids[some] @ centroids[among].T
            far[some[:, None] == among] = np.inf
            found = among[np.argpartition(far, links - 1, axis=1)[:, :links]]
            out.append(np.stack([np.repeat(some, links), found.ravel()], 1))
        return np.concatenate(out)

    every = np.arange(count)
    groups = balanced_means(centroids, max(1, int(np.sqrt(count))), 4)
    hubs = np.unique(((groups ** 2).sum(1)[:, None] - 2 * groups @ centroids.T + square).argmin(1))
    pairs = np.concatenate([
        nearest_of(every, every, DEGREE), nearest_of(every, hubs, 1), nearest_of(hubs, hubs, DEGREE),
        np.stack([hubs, np.roll(hubs, 1)], 1),
    ])
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    links = np.bincount(pairs[:, 0], minlength=count)
    graph = np.full((count, max(1, int(links.max(initial=0)))), -1, np.int32)
    graph[pairs[:, 0], np.arange(len(pairs)) - np.repeat(np.cumsum(links) - links, links)] = pairs[:, 1]
    return graph, hubs


def balanced_means(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """k-means whose crowded centroids pay a price, so that lists even out."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(np.int64)].copy()
    price = np.zeros(lists)
    for _ in range(rounds):
        square, place, cost = (centroids ** 2).sum(1), np.empty(len(sample), np.int64), np.empty(len(sample))
        for at in range(0, len(sample), 4096):
            part = sample[at:at + 4096]
            far = square + price - 2 * part @ centroids.T
            place[at:at + 4096] = far.argmin(1)
            cost[at:at + 4096] = far.min(1) + (part ** 2).sum(1)
        size = np.bincount(place, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, place, sample)
        full = size > 0
        centroids[full] = total[full] / size[full, None]
        price += 0.1 * max(float(np.abs(cost).mean()), 1e-12) * np.clip(size * lists / len(sample) - 1, -1, 2)
        price -= price.min()
    return centroids


def fit(vectors: DataFrame, rows: int, norm: float) -> Index:
    lists = int(min(MAX_LISTS, max(1, rows // LIST)))
    found = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PER_LIST * lists).select("vector").collect()
    sample = np.array([r.vector for r in found], float)
    index = Index(np.zeros((0, 0)), np.zeros((0, 0), np.int64), norm)
    lifted = np.unique(index.lift(sample), axis=0)
    lifted = lifted[np.random.default_rng(len(lifted)).permutation(len(lifted))]
    index.centroids = np.unique(balanced_means(lifted, min(lists, len(lifted))), axis=0)
    index.graph, index.hubs = linked(index.centroids)
    return index


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def valid_vectors(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, vector): the rows that take part."""
    kind = table.select(f"`{vector}`").schema[0].dataType
    kind = "array<float>" if kind.simpleString() == "array<float>" else "array<double>"
    held = table.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(kind).alias("vector")
    ).filter("vec_id is not null and vector is not null")
    unsound = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = held.filter(~unsound).filter(F.exists("vector", lambda x: x != 0))
    common = held.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return held.filter(F.size("vector") == (common.n if common else 0))


def distinct_vectors(held: DataFrame, queries: Column, k: int) -> DataFrame:
    """(name, vector, ids, asked): each vector once, with its k + 1 smallest ids and whether any row of it is a query."""
    named = held.select(
        F.xxhash64("vector").alias("name"), "vector", "vec_id", F.coalesce(queries, F.lit(False)).alias("asked"))

    def least(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, asked = batch["vec_id"].to_numpy(), batch["asked"].to_numpy(zero_copy_only=False)
            rows = np.ascontiguousarray(batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
            _, place = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_inverse=True)
            asked = np.bincount(place, weights=asked) > 0
            order = np.lexsort((ids, place))
            order = order[np.append(True, (np.diff(place[order]) != 0) | (np.diff(ids[order]) != 0))]
            rank = np.arange(len(order)) - np.searchsorted(place[order], place[order])
            kept = order[rank <= k]
            some = batch.take(pa.array(kept))
            yield some.set_column(3, "asked", pa.array(asked[place[kept]]))

    kept = named.mapInArrow(least, named.schema)  # so that no task collects all ids of a vector
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    return kept.groupBy("name", "vector").agg(ids.alias("ids"), F.max("asked").alias("asked"))


def nearest(
    table: DataFrame, queries: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = K
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query row.

    ``queries`` is a condition on vec_id.
    """
    held = valid_vectors(table, id_column, vector)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    found = held.agg(F.count(F.lit(1)), F.sqrt(F.max(norm))).first()
    rows = found[0]
    if not rows:
        return held.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    index = fit(held, rows, found[1])

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors, asked = _matrix(part["vector"]), part["asked"].to_numpy(zero_copy_only=False)
                lists, far = index.search(index.lift(vectors), 4 * COPIES)
                lists, far = lists[:, :COPIES], far[:, :COPIES]
                kept = far <= COPY_RATIO * far[:, :1]
                own = [row[ok].tolist() for row, ok in zip(lists, kept, strict=True)]
                beam, near = [[]] * len(vectors), np.zeros(len(vectors), np.int32)
                if asked.any():
                    lists, far = index.search(np.concatenate([vectors[asked], np.zeros((int(asked.sum()), 1))], 1))
                    near[asked] = (far <= READ_RATIO * far[:, :1]).sum(1)
                    for i, row in zip(np.flatnonzero(asked), lists, strict=True):
                        beam[i] = row.tolist()
                lists_of = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own, lists_of), pa.array(beam, lists_of), pa.array(near)],
                    [*part.schema.names, "lists", "beam", "near"])

    distinct = distinct_vectors(held, queries, k)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    assigned = materialize(
        distinct.mapInArrow(assign, f"{kinds}, lists array<int>, beam array<int>, near int")
        .withColumn("key", F.monotonically_increasing_id()), "postings")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in assigned.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # at most MAX_LISTS
        sizes[r["list"]] = r["count"]
    parts = np.maximum(1, -(-sizes // PART))
    first_part, shard = _layout(index.centroids, sizes, parts)

    kind = held.schema["vector"].dataType.simpleString()
    asked = assigned.filter("asked").select("key", "vector", "beam", "near").mapInArrow(
        lambda batches: _asked(batches, sizes, parts, first_part, shard, k),
        f"shard int, key long, query {kind}, units array<int>")
    chunks = np.zeros(int(shard.max()) + 1, np.int64)
    for r in asked.groupBy("shard").count().collect():  # one of about SHARD vectors
        chunks[r["shard"]] = -(-r["count"] // CHUNK)
    chunk_of = F.pmod(F.xxhash64("key"), F.element_at(F.lit(chunks.tolist()), F.col("shard") + 1)).cast("int")
    postings = assigned.select("key", "ids", "vector", "lists").mapInArrow(
        lambda batches: _postings(batches, parts, first_part, shard, chunks),
        f"shard int, chunk int, unit int, ids array<long>, vector {kind}")
    best = asked.withColumn("chunk", chunk_of).groupBy("shard", "chunk").cogroup(postings.groupBy("shard", "chunk")).applyInArrow(
        lambda _, q, p: _best(q, p, k), "key long, vec_id long, score double")

    def first(found: DataFrame, of: str, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(of).orderBy(F.desc("score"), "vec_id"))
        found = found.groupBy(of, "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= most)

    found = first(best, "key", k + 1).groupBy("key").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    found = found.join(assigned.filter("asked").select("key", "name", "vector"), "key").drop("key")
    asking = held.filter(queries).select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("name"), "vector")
    counts = asking.groupBy("name", "vector").agg(F.count(F.lit(1)).alias("n"))
    joined = spread_join(asking, found, ["name", "vector"], "query_id", counts)
    rows = joined.select("query_id", F.explode("found").alias("f")).select("query_id", "f.*").filter("vec_id != query_id")
    return first(rows, "query_id", k).select("query_id", "rank", "vec_id", "score")


def _layout(centroids: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first unit (part of a list) of each list, and the shard of each unit.

    Units are numbered so that near centroids follow each other, and shards take
    units in this order up to SHARD vectors: a query's lists are in few shards.
    """
    groups = balanced_means(centroids, max(1, int(np.sqrt(len(centroids)))), 4)
    far = (groups ** 2).sum(1) - 2 * centroids @ groups.T
    along = groups @ np.linalg.svd(groups - groups.mean(0), full_matrices=False)[2][0]
    order = np.lexsort((far.min(1), along[far.argmin(1)]))
    first = np.empty(len(sizes), np.int64)
    first[order] = np.cumsum(parts[order]) - parts[order]
    each = np.repeat((sizes / parts)[order], parts[order])
    return first, ((np.cumsum(each) - each) // SHARD).astype(np.int64)


def _postings(batches, parts, first_part, shard, chunks):
    """The vectors of each unit, once for every chunk of queries of its shard."""
    for batch in batches:
        lists = batch["lists"]
        count = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), count)
        flat = lists.flatten().to_numpy()
        keys = batch["key"].to_numpy()
        spread = (keys[owner].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.int64)
        unit = first_part[flat] + spread % parts[flat]
        for chunk in range(int(chunks[shard[unit]].max(initial=0))):
            held = np.flatnonzero(chunks[shard[unit]] > chunk)
            at = pa.array(owner[held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[unit[held]], pa.int32()), pa.array(np.full(len(held), chunk), pa.int32()),
                 pa.array(unit[held], pa.int32()), batch["ids"].take(at), batch["vector"].take(at)],
                ["shard", "chunk", "unit", "ids", "vector"])


def _asked(batches, sizes, parts, first_part, shard, k):
    """For each query and shard the units (parts of lists) to read there."""
    enough = COPIES * (k + 1)
    for batch in batches:
        rows = {"shard": [], "row": [], "units": []}
        for i, (beam, near) in enumerate(zip(batch["beam"].to_pylist(), batch["near"].to_pylist(), strict=True)):
            chosen = np.array(beam)
            read = (np.arange(len(chosen)) < near) | (np.append(0, np.cumsum(sizes[chosen])[:-1]) < enough)
            chosen = chosen[read]
            if sizes[chosen].sum() < enough:  # too few lists in the beam: take all
                chosen = np.arange(len(sizes))
            units = np.concatenate([np.arange(first_part[c], first_part[c] + parts[c]) for c in chosen])
            held = shard[units]
            for s in np.unique(held):
                rows["shard"].append(int(s))
                rows["row"].append(i)
                rows["units"].append(units[held == s].tolist())
        at_row = pa.array(rows["row"], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["shard"], pa.int32()), batch["key"].take(at_row), batch["vector"].take(at_row), pa.array(rows["units"], pa.list_(pa.int32()))],
            ["shard", "key", "query", "units"])


def _ranked(score: np.ndarray, rows: np.ndarray, start: np.ndarray, ids: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids of the rows and their scores; looks at the ``first`` best rows, at more if ids repeat."""
    while True:
        held = np.arange(len(score))
        if len(score) > first:
            held = np.flatnonzero(score >= np.partition(score, len(score) - first)[len(score) - first])
        count = start[rows[held] + 1] - start[rows[held]]
        at = np.repeat(start[rows[held]] - np.cumsum(count) + count, count) + np.arange(count.sum())
        mine, each = ids[at], np.repeat(score[held], count)
        ranked = np.lexsort((mine, -each))
        _, at = np.unique(mine[ranked], return_index=True)
        if len(at) >= k or len(held) == len(score):
            ranked = ranked[np.sort(at)][:k]
            return mine[ranked], each[ranked]
        first *= 4


def _best(asked: pa.Table, postings: pa.Table, k: int) -> pa.Table:
    """The k + 1 best ids of this shard's units for each query."""
    vectors, lists = _matrix(postings["vector"]), postings["ids"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ids, start = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    unit = postings["unit"].to_numpy()
    order = np.argsort(unit, kind="stable")
    unit = unit[order]
    found = {"key": [], "vec_id": [], "score": []}
    for slice_at in range(0, asked.num_rows, 512):
        some = asked.slice(slice_at, 512)
        queries, keys = _matrix(some["query"]), some["key"].to_numpy()
        for i, wanted in enumerate(some["units"].to_pylist()):
            low, high = np.searchsorted(unit, wanted), np.searchsorted(unit, wanted, "right")
            at = order[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])]
            if not len(at):
                continue
            best, score = _ranked(vectors[at] @ queries[i], at, start, ids, k + 1, COPIES * (k + 1))
            found["key"].append(np.full(len(best), keys[i]))
            found["vec_id"].append(best)
            found["score"].append(score)
    kinds = {"key": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    return pa.table({n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in found.items()})
