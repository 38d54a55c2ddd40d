"""Jaccard join of n-gram sets, size aware: subsets for small sets, lists for large.

Sets are turned into components of linked documents, without listing the pairs
inside a group of copies.

1. Filter. A set that links to another shares at least ``similarity`` of its
   shingles with it, so enough of its smallest shingles (by name) occur in another
   document. Blocks exchange these names; sets without enough shared ones are done.
2. Classes. Documents with equal sets are one class from here on.
3. Hubs. Every class gets the label of the hub that most of its first shingles
   have in common, so near copies mostly share one. A few rounds link classes to
   one hub of a list and verify the pair; big groups fall into few components.
4. Within a label, classes of different components are compared tile by tile.
5. Between labels, pairs that may link are found by prefixes in a common order of
   the shingles: those of one label first, then those of several, which alone can
   meet. Small sets enumerate two-element subsets of their prefix, large ones (and
   those next to the boundary) are found by scanning inverted lists of single
   shingles. The boundary is the size at which subsets and the lists behind them
   start to cost more than scanning lists. Pairs found are verified on whole sets.

Two sets A and B with |A & B| >= o share at least c elements among the first
|A| - o + c of A and |B| - o + c of B in any common order; o is at least
``similarity`` times each size, which bounds both prefixes by the set alone.

Edge cases: NULL and texts without words have no shingles and link with nothing;
texts with fewer words than a shingle are one shingle. Equal texts are linked. A
null id takes part and never is the smallest; a component of null ids alone has a
null id. Repeated rows are linked copies. Empty tables give empty results. Other
columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm import blocks as B
from lintmill.llm import words as W
from lintmill.llm.components import least_labels
from lintmill.session import materialize

SHINGLE = 5
SIMILARITY = 75     # percent
FILTER_SHARE = 40   # percent of a set that the filter looks at
HUB_ROUNDS = 2
HUB_TOKENS = 8      # shingles of a class that look for a hub
GROUP = 256         # sets that one verifying task holds on each side

SETS = "uid long, id long, n int, set_key binary, near boolean"
CLASSES = "cid long, n int, members binary"


def shingle_sets(words: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle names of all documents, and where each set begins."""
    starts = W.gram_starts(words.first, size)
    name = W.grams(words.name, size)[starts] if len(starts) else np.zeros(0, np.uint64)
    count = np.diff(words.first)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - size + 1, 0))
    for n in range(1, size):  # a shorter text is one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            name = np.append(name, W.grams(words.name, n)[words.first[short]])
            doc = np.append(doc, short)
    order = np.argsort(doc, kind="stable")
    name, doc = name[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(count) + 1))
    for d in range(len(count)):
        name[first[d]:first[d + 1]].sort()
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    return name[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def needed(n: np.ndarray, similarity: int) -> np.ndarray:
    """The least overlap of a set of size n with any set it links to."""
    return -(-n * similarity // 100)


def looked_at(n):
    """How many of a set's smallest shingles the filter looks at."""
    return np.minimum(n, -(-n * FILTER_SHARE // 100) + 1)


def least_shared(n: np.ndarray, similarity: int) -> np.ndarray:
    """How many of the shingles looked at a set of size n shares with any set it links to.

    Sets of sizes a and b that link overlap in o = needed of both sizes together, and
    share at least min(looked(a) - a, looked(b) - b) + o of what is looked at. The
    first grows with b and the second falls, so both ends of b's range bound them
    (two are taken off for rounding; small sizes try every b).
    """
    sizes, place = np.unique(n, return_inverse=True)
    out = np.zeros(len(sizes), np.int64)
    for i, a in enumerate(sizes.tolist()):
        b = np.arange(-(-a * similarity // 100), a * 100 // similarity + 1) if a <= 256 else np.array(
            [-(-a * similarity // 100), a * 100 // similarity])
        if a:
            both = -(-(a + b) * similarity // (100 + similarity))
            out[i] = (np.minimum(looked_at(a) - a, looked_at(b) - b) + both).min() - 2 * (a > 256)
    return np.maximum(out, 1)[place]


class _Block:
    def __init__(self, table: pa.Table, size: int, similarity: int, buckets: int):
        self.number, self.buckets, self.similarity = table["block"][0].as_py(), buckets, similarity
        self.name, self.first = shingle_sets(W.split_words(table["text"], lower=True), size)
        self.n = np.diff(self.first)
        self.looked = looked_at(self.n)
        doc = np.repeat(np.arange(len(self.n)), self.n)
        self.rank = np.arange(len(self.name)) - self.first[doc]
        self.doc = doc
        self.inside = self.rank < self.looked[doc]
        self.sent, place, counts = np.unique(W.mix(self.name[self.inside].copy()), return_inverse=True, return_counts=True)
        self.place, self.twice = place, counts > 1

    def send(self) -> pa.Table:
        return B.sent_rows(self.number, self.sent, [self.sent.astype(np.uint32)], self.buckets)

    def answer(self, blobs: list[bytes]) -> None:
        """Which sets may link."""
        shared = (B.flags_of(self.sent, self.buckets, blobs) | self.twice)[self.place]
        found = np.bincount(self.doc[self.inside], weights=shared, minlength=len(self.n))
        self.near = (self.n > 0) & (found >= least_shared(self.n, self.similarity))

    def members(self, d: int) -> bytes:
        return self.name[self.first[d]:self.first[d + 1]].tobytes()

    def key(self, d: int) -> bytes:
        return hashlib.blake2b(self.members(d), digest_size=16).digest()


def _tokens(single: int, several: np.ndarray, n: int, similarity: int, boundary: int) -> np.ndarray:
    """Names under which a set looks for partners of other labels.

    ``single`` of its shingles belong to one label and come first in the common
    order; ``several`` are the others.
    """
    spare = n - int(needed(np.array(n), similarity))
    out = [np.zeros(0, np.uint64)]
    if n <= boundary:
        prefix = several[:max(0, spare + 2 - single)]
        i, j = np.triu_indices(len(prefix), 1)
        out.append(W.join_names(prefix[i], prefix[j], 2) & ~np.uint64(1))
    if n > boundary or n * 100 >= similarity * (boundary + 1):
        out.append(several[:max(0, spare + 1 - single)] | np.uint64(1))
    return np.concatenate(out).view(np.int64)


def _first_tokens(batches):
    """A row for each of the first shingles of every class."""
    for batch in batches:
        found = [np.frombuffer(m, np.int64)[:HUB_TOKENS] for m in batch["members"].to_pylist()]
        count = [len(f) for f in found]
        if sum(count):
            at = pa.array(np.repeat(np.arange(len(count)), count))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), batch["cid"].take(at), batch["n"].take(at)], ["token", "cid", "n"])


def _verify(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Components of those pairs (a, b) that link. ``g`` groups pairs whose sets one task holds."""
    wanted = pairs.select(F.col("g").alias("held"), F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = wanted.join(classes, "cid")

    def check(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        cid = held["cid"].to_numpy()
        place = {c: i for i, c in enumerate(cid.tolist())}
        n = held["n"].to_numpy().astype(np.int64)
        members = [np.frombuffer(m, np.uint64) for m in held["members"].to_pylist()]
        a = np.array([place[x] for x in asked["a"].to_pylist()], np.int64)
        b = np.array([place[x] for x in asked["b"].to_pylist()], np.int64)
        linked = np.zeros(len(a), bool)
        order = np.argsort(a, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            if not len(part):
                continue
            own = members[a[part[0]]]
            others = [members[i] for i in b[part]]
            size = np.array([len(x) for x in others])
            flat = np.concatenate(others)
            if not len(own) or not len(flat):
                continue
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            hits = np.append(0, np.cumsum(own[at] == flat))
            ends = np.cumsum(size)
            both = hits[ends] - hits[ends - size]
            linked[part] = 100 * both >= similarity * (n[a[part]] + n[b[part]] - both)
        kept = asked.filter(pa.array(linked))
        return pa.table({"a": kept["a_component"], "b": kept["b_component"]})

    return pairs.select("g", "a", "b", "a_component", "b_component").groupBy("g").cogroup(sets.groupBy("held")).applyInArrow(
        lambda key, p, s: check(key, p, s), "a long, b long"
    )


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """Components after verified links between them."""
    labels = least_labels(links)
    return materialize(
        component.join(labels.select(F.col("node").alias("component"), F.col("label").alias("least")), "component", "left")
        .select("cid", "n", F.coalesce("least", "component").alias("component"), "label"), "components",
    )


def _fits(similarity: int):
    return F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * similarity


def _hub_round(tokens: DataFrame, component: DataFrame, classes: DataFrame, similarity: int, turn: int):
    """Links of each class to at most one hub, as components; None if no list spans components."""
    held = tokens.join(component.select("cid", "component"), "cid")
    hubs = held.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min_by(F.struct("cid", "n", "component"), F.xxhash64("cid", F.lit(turn))).alias("hub"),
    ).filter("low <> high").select("token", F.col("hub.cid").alias("b"), F.col("hub.n").alias("b_n"), F.col("hub.component").alias("hub"))
    votes = (
        held.join(hubs, "token").withColumnRenamed("n", "a_n").filter("component <> hub").filter(_fits(similarity))
        .groupBy(F.col("cid").alias("a"), F.col("component").alias("a_component"), "b", F.col("hub").alias("b_component")).count()
        .groupBy("a", "a_component").agg(
            F.max_by(F.struct("b", "b_component"), F.struct("count", F.xxhash64("a", "b"))).alias("found"))
        .select("a", "a_component", "found.*")
    )
    votes = materialize(votes, "pairs")
    if votes.isEmpty():
        return None
    size = votes.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / (2 * GROUP)).alias("parts"))
    pairs = votes.join(size, "b").select("a", "b", "a_component", "b_component", F.xxhash64("b", F.pmod(F.xxhash64("a"), "parts")).alias("g"))
    return _verify(pairs, classes, similarity)


def _cost_boundary(tokens: DataFrame, similarity: int) -> int:
    """The largest size for which two-element subsets cost no more than lists.

    A set with p = n - needed(n) + 1 prefix shingles scans p lists of mean length
    L, or p (p + 1) / 2 subsets whose lists have mean length L2; both lengths are
    measured on the first shingles of all classes.
    """
    mean = lambda df: float(df.agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("m")).first()[0] or 1)
    one = mean(tokens.groupBy("token").count())
    other = tokens.select(F.col("cid").alias("c"), F.col("token").alias("other"))
    pairs = tokens.join(other, F.col("cid") == F.col("c")).filter("token < other")  # at most 28 for a class
    two = mean(pairs.groupBy("token", "other").count())
    prefix = 2 * (1 + one) / (1 + two) - 1
    return int(max(prefix, 0) * 100 // (100 - similarity))


def _labels(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, n, label): the hub that most of a class's first shingles have, and that hub's hub."""
    hubs = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min_by("cid", F.xxhash64("cid", F.lit(0))).alias("hub"))
    votes = (
        tokens.join(hubs.filter("size > 1").drop("size"), "token").groupBy("cid", "hub").count()
        .groupBy("cid").agg(F.max_by("hub", F.struct("count", F.xxhash64("hub"))).alias("hub"))
    )
    votes = materialize(votes, "hubs")
    again = votes.select(F.col("cid").alias("hub"), F.col("hub").alias("label"))
    found = votes.join(again, "hub", "left").select("cid", F.coalesce("label", "hub").alias("label"))
    return classes.select("cid", "n").join(found, "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _same_label_links(classes: DataFrame, component: DataFrame, similarity: int) -> DataFrame:
    """Links between components of one label, as components. Tiles hold about GROUP sets; those of one component are not compared."""
    held = component.select("cid", "component", "label")
    sizes = held.groupBy("label", "component").count()
    open_labels = sizes.groupBy("label").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("label")
    big = sizes.filter(F.col("count") >= GROUP).select("label", "component", F.col("component").alias("big"))
    held = held.join(open_labels, "label").join(big, ["label", "component"], "left")
    share = held.groupBy("label", "big").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("shares"))
    share = share.select(F.col("label").alias("l"), F.col("big").alias("b"), "shares")
    tiled = held.join(share, (F.col("label") == F.col("l")) & F.col("big").eqNullSafe(F.col("b"))).select(
        "cid", "component", "label", "big", F.xxhash64("label", "big", F.pmod(F.xxhash64("cid"), "shares")).alias("tile"))
    tiled = materialize(tiled, "tiles")
    tiles = tiled.select("label", "big", "tile").distinct()
    other = tiles.select(F.col("label").alias("l"), F.col("big").alias("b"), F.col("tile").alias("t"))
    pairs = tiles.join(other, (F.col("label") == F.col("l")) & (F.col("tile") <= F.col("t"))).filter(
        "big is null or b is null or big <> b").select(F.xxhash64("tile", "t").alias("g"), "tile", "t")
    ends = pairs.select("g", F.explode(F.array("tile", "t")).alias("tile")).distinct()
    whole = tiled.join(classes, "cid").join(ends, "tile").select("g", "tile", "cid", "component", "n", "members")
    return whole.groupBy("g").applyInArrow(lambda key, t: _tile_links(t, similarity), "a long, b long")


def _tile_links(held: pa.Table, similarity: int) -> pa.Table:
    """Links between two tiles (or within one), by products of their membership matrices, as components."""
    tile, n = held["tile"].to_numpy(), held["n"].to_numpy().astype(np.int64)
    component = held["component"].to_numpy()
    members = [np.frombuffer(m, np.uint64) for m in held["members"].to_pylist()]
    left = np.flatnonzero(tile == tile.min())
    right = np.flatnonzero(tile == tile.max())
    flat = lambda at: (np.concatenate([members[i] for i in at]), np.repeat(np.arange(len(at)), [len(members[i]) for i in at]))
    (a_token, a_row), (b_token, b_row) = flat(left), flat(right)
    common = np.intersect1d(a_token, b_token)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), 4096):
        part = common[at:at + 4096]
        matrices = []
        for token, row, count in ((a_token, a_row, len(left)), (b_token, b_row, len(right))):
            place = np.minimum(np.searchsorted(part, token), len(part) - 1)
            hit = part[place] == token
            matrix = np.zeros((count, len(part)), np.float32)
            matrix[row[hit], place[hit]] = 1
            matrices.append(matrix)
        both += matrices[0] @ matrices[1].T
    union = n[left][:, None] + n[right][None, :] - both
    linked = (100 * both >= similarity * union) & (component[left][:, None] != component[right][None, :])
    i, j = _forest(left, right, linked, len(component))
    return pa.table({"a": pa.array(component[i], pa.int64()), "b": pa.array(component[j], pa.int64())})


def _forest(left: np.ndarray, right: np.ndarray, linked: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links as connect the same sets: each set reached, from the one that reached it."""
    table = np.zeros((count, count), bool)
    table[np.ix_(left, right)] = linked
    table |= table.T
    reached, pairs = np.zeros(count, bool), []
    for start in range(count):
        if reached[start]:
            continue
        reached[start] = True
        waiting = [start]
        while waiting:
            one = waiting.pop()
            new = np.flatnonzero(table[one] & ~reached)
            reached[new] = True
            pairs += [(one, k) for k in new.tolist()]
            waiting += new.tolist()
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _label_flags(classes: DataFrame, buckets: int) -> DataFrame:
    """For each block of classes, which of its shingles occur under several labels."""

    def send(key, t):
        token, mark = _marked(t)
        new = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        low, high = (f.reduceat(mark, new) if len(new) else mark for f in (np.minimum, np.maximum))
        names = token[new]
        one = np.where(low == high, low, np.uint64(0))  # 0: several labels
        return B.sent_rows(t["block"][0].as_py(), names, [names.astype(np.uint32), one], buckets)

    def answer(blobs: list[bytes]) -> list[bytes]:
        sizes = [len(b) // 12 for b in blobs]
        names = np.concatenate([np.frombuffer(b, "<u4", k) for b, k in zip(blobs, sizes, strict=True)])
        marks = np.concatenate([np.frombuffer(b, "<u8", k, 4 * k) for b, k in zip(blobs, sizes, strict=True)])
        _, place = np.unique(names, return_inverse=True)
        low = np.full(place.max(initial=-1) + 1, (1 << 64) - 1, np.uint64)
        high = np.zeros(len(low), np.uint64)
        np.minimum.at(low, place, marks)
        np.maximum.at(high, place, marks)
        several = ((low != high) | (low == 0))[place]
        return [np.packbits(x).tobytes() for x in np.split(several, np.cumsum(sizes)[:-1])]

    return B.exchange(classes.groupBy("block").applyInArrow(send, B.SENT), answer)


def _marked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a block's classes in order, with a 64-bit mark of their label (never 0)."""
    members = [np.frombuffer(m, np.uint64) for m in t["members"].to_pylist()]
    mark = t["label"].to_numpy().astype(np.int64).view(np.uint64) + np.uint64(1)
    token = np.concatenate(members) if members else np.zeros(0, np.uint64)
    marks = np.repeat(mark, [len(m) for m in members])
    order = np.argsort(token, kind="stable")
    return token[order], marks[order]


def _cross_label_pairs(
    classes: DataFrame, component: DataFrame, similarity: int, boundary: int, buckets: int, bits: int
) -> DataFrame:
    """Pairs (a, b) of classes with different labels and components that may link, in groups ``g``."""
    whole = classes.drop("n").join(component, "cid").withColumn("block", F.shiftright("cid", bits))
    whole = whole.select("block", "cid", "n", "component", "label", "members")
    flags = _label_flags(whole, buckets)
    kept = ["cid", "n", "component", "label"]

    def look(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        names = np.unique(_marked(t)[0]) if t.num_rows else np.zeros(0, np.uint64)
        several = names[B.flags_of(names, buckets, B.ordered(answers))]
        found = []
        for m, n in zip(t["members"].to_pylist(), t["n"].to_pylist(), strict=True):
            own = np.frombuffer(m, np.uint64)
            shared = own[np.isin(own, several)]
            found.append(_tokens(len(own) - len(shared), shared, n, similarity, boundary))
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64))
        tokens = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.table({"token": pa.array(tokens, pa.int64()), **{c: t[c].take(at) for c in kept}})

    tokens = materialize(
        whole.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(
            look, "token long, cid long, n int, component long, label long"), "lists")
    side = lambda s: tokens.select("token", *[F.col(c).alias(f"{s}_{c}") for c in kept])
    pairs = (
        side("a").join(side("b"), "token")
        .filter("a_cid < b_cid and a_component <> b_component and a_label <> b_label").filter(_fits(similarity))
        .filter(f"token % 2 = 0 or greatest(a_n, b_n) > {boundary}")
        .select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"), "a_component", "b_component",
                F.xxhash64(F.least("a_label", "b_label"), F.greatest("a_label", "b_label")).alias("labels")).distinct()
    )
    pairs = materialize(pairs, "pairs")
    sizes = pairs.groupBy("labels").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / (GROUP * GROUP))).alias("parts"))
    return pairs.join(sizes, "labels").select(
        "a", "b", "a_component", "b_component", F.xxhash64("labels", F.pmod(F.xxhash64("a"), "parts"), F.pmod(F.xxhash64("b"), "parts")).alias("g"))


def linked_documents(
    docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, similarity: int = SIMILARITY
) -> DataFrame:
    """Set size and component of every document.

    Returns uid, the id column, n_shingles, component_id (the smallest id that
    links reach) and first_uid (the row with that id, of several the first).
    """
    return _linked(B.write_blocks(docs), id_column, shingle, similarity)


def one_per_component(
    docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, similarity: int = SIMILARITY
) -> DataFrame:
    """One whole document of each component: that with the smallest id."""
    made = B.write_blocks(docs)
    kept = _linked(made, id_column, shingle, similarity).filter("uid = first_uid").select("uid")
    found = made.table.join(kept, "uid", "left_semi")
    return found.select("text", *B.row_columns(found)).select(*[f"`{c}`" for c in docs.columns])


def _linked(made: B.Blocks, id_column: str, shingle: int, similarity: int) -> DataFrame:
    buckets = made.buckets
    texts = made.table.select("block", "text")
    block = lambda t: _Block(t, shingle, similarity, buckets)

    sent = texts.groupBy("block").applyInArrow(lambda key, t: block(t).send(), B.SENT)
    flags = materialize(B.exchange(sent, B.shared_flags("<u4", 4)), "shared")

    def describe(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        one = block(t)
        one.answer(B.ordered(answers))
        rows = range(t.num_rows)
        return pa.table({
            "uid": t["uid"], "id": t["id"], "n": pa.array(one.n, pa.int32()),
            "set_key": pa.array([one.key(d) if one.near[d] else None for d in rows], pa.binary()),
            "near": pa.array(one.near),
        })

    named = made.table.select("block", "uid", "text", F.col(f"row.`{id_column}`").cast("long").alias("id"))
    sets = materialize(named.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(describe, SETS), "sets")

    # Sizes of which only equal sets can link need no search.
    searched = (F.col("n") * 100 >= similarity * (F.col("n") + 1)) | ((F.col("n") - 1) * 100 >= similarity * F.col("n"))
    by_key = materialize(
        sets.filter("near").groupBy("set_key").agg(
            F.min("uid").alias("cid"), F.first("n").alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("least")
        ), "classes",
    )
    asked = by_key.filter(searched).select(F.shiftright("cid", made.bits).alias("block"), F.col("cid").alias("wanted"))

    def members(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        wanted = set(answers["wanted"].to_pylist())
        if not wanted:
            return pa.table({"cid": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "members": pa.array([], pa.binary())})
        one = block(t)
        rows = [(u, d) for d, u in enumerate(t["uid"].to_pylist()) if u in wanted]
        return pa.table({
            "cid": pa.array([u for u, _ in rows], pa.int64()), "n": pa.array([one.n[d] for _, d in rows], pa.int32()),
            "members": pa.array([one.members(d) for _, d in rows], pa.binary()),
        })

    whole = made.table.select("block", "uid", "text")
    classes = B.write_bucketed(whole.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(members, CLASSES), "cid")

    few = materialize(classes.mapInArrow(_first_tokens, "token long, cid long, n int"), "tokens")
    component = materialize(_labels(few, classes).withColumn("component", F.col("cid")), "components")
    for turn in range(HUB_ROUNDS):
        links = _hub_round(few, component, classes, similarity, turn)
        if links is None:
            break
        component = _merged(component, links)
    boundary = _cost_boundary(few, similarity)
    component = _merged(component, _same_label_links(classes, component, similarity))
    pairs = _cross_label_pairs(classes, component, similarity, boundary, buckets, made.bits)
    component = _merged(component, _verify(pairs, classes, similarity))

    # Back to documents: classes without a search are components of their own.
    grouped = by_key.join(component.select("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = grouped.groupBy("component").agg(F.min("least").alias("least"))
    of_key = grouped.join(least.withColumnRenamed("least", "first"), "component").select(
        "set_key", F.col("first.id").alias("component_id"), F.col("first.uid").alias("first_uid")
    )
    alone = sets.filter("not near").select(
        "uid", F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"),
        F.col("id").alias("component_id"), F.col("uid").alias("first_uid"),
    )
    together = sets.filter("near").join(of_key, "set_key").select(
        "uid", F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"), "component_id", "first_uid"
    )
    return alone.unionByName(together)
