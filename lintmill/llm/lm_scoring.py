"""Language-model scores by a weighted backoff automaton.

Smoothed n-grams are states and arcs. The state of order n is the last n - 1
tokens. A seen n-gram is an arc with the weight of its own probability; any other
token follows the failure arc, whose weight is the mass that smoothing keeps for
it, to the next shorter history, down to the state without one, which knows every
token. A text is scored in one traversal from left to right that adds up the
log10 weights of the arcs it takes. With c the counts of the training tokens and
c(h) those of a history, a state h gives

    P(w | h) = (c(hw) + strength * P(w | h')) / (c(h) + strength)

where h' is h without its first token, so a failure arc weighs
strength / (c(h) + strength). The state without history is the base model
(c(w) + 0.5) / (N + 0.5 (V + 1)), whose last half count is that of unknown words.

The automaton grows with the corpus and no task holds it. Each block of documents
sends the n-grams it has, with its own training counts, to name buckets and gets
the totals back (see blocks.py): exactly the states and arcs its texts can visit.

Edge cases: NULL and empty texts have one token, their end. Repeated rows are
scored alike and each counts. An empty table gives an empty result; without
training rows only the half counts remain. A null id counts as the text '' in
the split. Other columns are kept; one named like a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm import blocks as B
from lintmill.llm import words as W
from lintmill.session import materialize

ORDER = 2
STRENGTH = 4.0
RESULTS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

_END = np.uint64(0x656E645F746F6B65)    # the name of the end token
_START = np.uint64(0x73746172745F746F)  # stands before the first token


class _Block:
    """Tokens and n-grams of one block. A name's two lowest bits are its order."""

    def __init__(self, table: pa.Table, order: int):
        self.number = table["block"][0].as_py()
        words = W.split_words(table["text"], lower=True)
        docs = len(words.first) - 1
        pad = order - 1  # start tokens before each document, one end behind
        self.count = np.diff(words.first) + 1
        self.begin = np.append(0, np.cumsum(self.count))
        at = np.arange(len(words.name)) + words.doc_of_word()
        tokens = np.full(int(self.begin[-1]), _END)
        tokens[at] = words.name
        self.trains = np.repeat(~table["held_out"].to_numpy(), self.count)
        self.doc_first = np.repeat(np.arange(docs), self.count)
        padded = np.full(len(tokens) + docs * pad, _START)
        place = np.arange(len(tokens)) + (self.doc_first + 1) * pad
        padded[place] = tokens
        names = []
        for n in range(1, order + 1):
            found = W.grams(padded, n)[place - (n - 1)]
            names.append(found & ~np.uint64(3) | np.uint64(n))
        self.names, inverse = np.unique(np.concatenate(names), return_inverse=True)
        self.grams = np.split(inverse.astype(np.int32), order)
        self.order = order

    def send(self, buckets: int) -> pa.Table:
        counts = sum(np.bincount(g[self.trains], minlength=len(self.names)) for g in self.grams)
        parts = [self.names.astype(np.uint32), (self.names >> np.uint64(32)).astype(np.uint16), counts.astype(np.uint32)]
        return B.sent_rows(self.number, self.names, parts, buckets)

    def scores(self, totals: np.ndarray, strength: float, tokens: int, distinct: int, documents: int):
        """Known tokens, base score and automaton score of each document."""
        seen = totals[self.grams[0]].astype(np.float64)
        weight = (seen + 0.5) / (tokens + 0.5 * (distinct + 1))
        base = np.log10(weight)
        for n in range(2, self.order + 1):
            arc = totals[self.grams[n - 1]].astype(np.float64)
            # The state is the n - 1 tokens before: at a text's first token, starts alone.
            state = np.empty(len(arc))
            state[1:] = totals[self.grams[n - 2]][:-1]
            state[self.begin[:-1]] = documents
            weight = (arc + strength * weight) / (state + strength)
        added = lambda x: np.add.reduceat(x, self.begin[:-1]) if len(x) else x
        return added((seen > 0).astype(np.int64)), added(base), added(np.log10(weight))


ANSWERED = B.SENT + ", tokens long, distinct_tokens long"


def _answer(table: pa.Table) -> pa.Table:
    """Totals for each block that asked, and a row (block -1) with the bucket's tokens."""
    blobs = table["blob"].to_pylist()
    sizes = [len(b) // 10 for b in blobs]
    part = lambda kind, at: np.concatenate(
        [np.frombuffer(b, kind, n, at * n) for b, n in zip(blobs, sizes, strict=True)]
    )
    low, high, count = part("<u4", 0), part("<u2", 4), part("<u4", 6)
    _, first, place = np.unique(high.astype(np.uint64) << np.uint64(32) | low, return_index=True, return_inverse=True)
    total = np.bincount(place, weights=count).astype(np.uint64)  # exact below 2**53
    total = total.astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.uint64)
    tokens = total[low[first] & 3 == 1].astype(np.int64)
    replies = [x.tobytes() for x in np.split(total[place], np.cumsum(sizes)[:-1])]
    rows = table.num_rows
    return pa.table({
        "block": pa.array([*table["block"].to_pylist(), -1], pa.int64()),
        "bucket": pa.array([table["bucket"][0].as_py()] * (rows + 1), pa.int32()),
        "blob": pa.array([*replies, b""], pa.binary()),
        "tokens": pa.array([None] * rows + [int(tokens.sum())], pa.int64()),
        "distinct_tokens": pa.array([None] * rows + [np.count_nonzero(tokens)], pa.int64()),
    })


def _totals(edges: np.ndarray, blobs: list[bytes]) -> np.ndarray:
    """What the buckets answered for a block's sorted names: 4 or 8 bytes a name."""
    counts = [n for n in np.diff(edges) if n]
    return np.concatenate([np.frombuffer(b, f"<u{len(b) // n}").astype(np.uint64) for n, b in zip(counts, blobs, strict=True)])


def score_texts(
    docs: DataFrame, held_out: Column, order: int = ORDER, strength: float = STRENGTH
) -> DataFrame:
    """Score every text by a model of those that are not ``held_out``.

    Adds held_out, n_tokens, n_known, train_tokens, base_score and score (log10).
    """
    marked = docs.drop(*RESULTS).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    made = B.write_blocks(marked)
    buckets = made.buckets
    texts = made.table.select("block", "text", F.col("row.held_out").alias("held_out"))
    sent = texts.groupBy("block").applyInArrow(lambda key, t: _Block(t, order).send(buckets), B.SENT)
    answers = materialize(sent.groupBy("bucket").applyInArrow(lambda key, t: _answer(t), ANSWERED), "counts")
    found = answers.filter("block = -1").agg(F.sum("tokens"), F.sum("distinct_tokens")).first()
    tokens, distinct = found[0] or 0, found[1] or 0
    documents = made.table.filter("not row.held_out").count()

    def score(key, t, found):
        if not t.num_rows:
            return pa.table({"row": t["row"], **{k: pa.array([], v) for k, v in kinds.items()}})
        block = _Block(t.append_column("held_out", pa.compute.struct_field(t["row"], "held_out")), order)
        totals = _totals(B.edges(block.names, buckets), B.ordered(found))
        known, base, total = block.scores(totals, strength, tokens, distinct, documents)
        values = (block.count, known, np.full(len(known), tokens), base, total)
        return pa.table({"row": t["row"], **{k: pa.array(x, kinds[k]) for k, x in zip(kinds, values, strict=True)}})

    kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    whole = made.table.drop("uid")
    out = whole.groupBy("block").cogroup(answers.filter("block >= 0").select("block", "bucket", "blob").groupBy("block")).applyInArrow(
        score, B.with_row(made.table, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
    return out.select(*B.row_columns(out), "n_tokens", "n_known", "train_tokens", "base_score", "score")
