"""Quality scores by positive-unlabelled learning.

Trusted positives are labelled good; the unlabelled are web texts taken whatever
their labels say. The model minimises the non-negative unbiased risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the logistic loss; where the second part falls below zero, a step is taken
back on it, so that the model does not learn single unlabelled texts by heart. The
prior is the share of good texts among the labelled training rows. g is additive
over binned text statistics (how a text is written, never its id, language or
source), taken over whole texts, many texts at a time.

Training takes at most ``sample`` positives and as many unlabelled, those with the
least hash of their id; their statistics, a few dozen numbers each, are fitted on
the driver. Scoring is one pass over all texts.

Edge cases: NULL and empty texts have the statistics of no words and a score like
any other. Without positives every score is the prior (0.5 without labels). Ids
that occur twice count once per row; null ids match no label. Other columns stay;
score and predicted are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm import blocks as B
from lintmill.llm import words as W

SAMPLE = 20_000
BINS = 12
STEPS = 400
RATE = 0.1
PENALTY = 1e-4

_KINDS = {
    "symbol": b"#$%&*+/<=>@\\^_`{|}~[]()",
    "bar": b"|",
    "loud": b"!?",
    "digit": b"0123456789",
    "upper": bytes(range(65, 91)),
    "stop": b".",
    "comma": b",;:",
    "line": b"\n",
}
_TABLES = {name: np.isin(np.arange(256), np.frombuffer(kind, np.uint8)) for name, kind in _KINDS.items()}
FEATURES = [*_KINDS, "words", "word_bytes", "repeat", "distinct", "top", "line_words"]


def statistics(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of FEATURES per text."""
    words = W.split_words(texts)
    docs = len(words.first) - 1
    offsets = W.text_bytes(texts)[1]
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((docs, len(FEATURES)))
    data = words.data
    for k, table in enumerate(_TABLES.values()):
        seen = np.append(0, np.cumsum(table[data[:offsets[-1]]], dtype=np.int64))
        out[:, k] = np.diff(seen[offsets]) / size
    count = np.diff(words.first)
    most = np.maximum(count, 1)
    lines = out[:, FEATURES.index("line")] * size + 1
    doc = words.doc_of_word()
    per = lambda weights: np.bincount(doc, weights=weights, minlength=docs)
    again = np.zeros(len(doc), bool)
    again[1:] = (words.name[1:] == words.name[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((words.name, doc)) if len(doc) else np.zeros(0, np.int64)
    name = words.name[order]
    new = np.ones(len(doc), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])  # doc itself is in order
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(doc)))
    top = np.zeros(docs)
    np.maximum.at(top, doc[begin], times)
    rest = {
        "words": np.log1p(count), "word_bytes": per(words.end - words.start) / most, "repeat": per(again) / most,
        "distinct": per(new) / most ** 0.9, "top": top / most, "line_words": np.log1p(count / lines),
    }
    for name, values in rest.items():
        out[:, FEATURES.index(name)] = values
    return out


@dataclass
class Model:
    cuts: np.ndarray     # features x (bins - 1)
    weights: np.ndarray  # one per feature and bin, and a constant

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(binned(stats, self.cuts) @ self.weights, -30, 30)))


def binned(stats: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    docs, features = stats.shape
    width = cuts.shape[1] + 1
    out = np.zeros((docs, features * width + 1))
    out[:, -1] = 1
    for f in range(features):
        out[np.arange(docs), f * width + np.searchsorted(cuts[f], stats[:, f])] = 1
    return out


def bin_cuts(stats: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Bounds at quantiles, closer at both ends, where odd texts are."""
    at = np.concatenate([[0.01, 0.03, 0.07], np.linspace(0.15, 0.85, bins - 7), [0.93, 0.97, 0.99]])
    return np.quantile(stats, at, axis=0).T + 1e-9


def non_negative_fit(
    good: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY
) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk (Adam, whole sample)."""
    weights = np.zeros(good.shape[1])
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    plus = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = good @ weights, unlabelled @ weights
        pull = -prior * good.T @ plus(-zp) / len(good)
        push = unlabelled.T @ plus(zu) / len(unlabelled) - prior * good.T @ plus(zp) / len(good)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        slope = (pull + push if risk >= 0 else -push) + penalty * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        weights -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return weights


def sample_statistics(docs: DataFrame, ids: DataFrame, id_column: str, text: str) -> np.ndarray:
    """Statistics of the texts with the given ids (few by construction)."""
    chosen = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), "id", "left_semi")

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["id"].cast(pa.int64()), pa.array([x.tobytes() for x in statistics(batch["text"])], pa.binary())], ["id", "stats"])

    found = chosen.mapInArrow(measure, "id long, stats binary").orderBy("id", "stats").collect()
    return np.array([np.frombuffer(r.stats) for r in found]).reshape(-1, len(FEATURES))


def train(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text",
    label: str = "quality", sample: int = SAMPLE,
) -> tuple[Model | None, float]:
    """The model and the prior, from rows that are not held out."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label).alias("label"), held_out.alias("held_out"))
    known = known.filter("id is not null and label is not null and not held_out").distinct()
    found = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not found[0] or not found[1]:
        return None, 0.5
    prior = min(max(found[1] / found[0], 0.02), 0.98)
    pick = lambda df, n: df.orderBy(F.xxhash64("id"), "id").limit(n)
    good_ids = pick(known.filter("label = 1").select("id").distinct(), sample)
    web_ids = pick(docs.filter(~held_out).select(F.col(id_column).alias("id")).filter("id is not null").distinct(), sample)
    good = sample_statistics(docs, good_ids, id_column, text)
    web = sample_statistics(docs, web_ids, id_column, text)
    if not len(good) or not len(web):
        return None, prior
    cuts = bin_cuts(web)
    return Model(cuts, non_negative_fit(binned(good, cuts), binned(web, cuts), prior)), prior


def score(docs: DataFrame, model: Model | None, prior: float = 0.5, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds score and predicted to every row."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    if model is None:
        scored = docs.select(*[f"`{c}`" for c in kept]).withColumn("score", F.lit(float(prior)))
    else:
        held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text]).alias("row"), F.col(f"`{text}`").alias("text"))

        def rate(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    found = model.score(statistics(part["text"]))
                    yield pa.RecordBatch.from_arrays([part["row"], part["text"], pa.array(found)], ["row", "text", "score"])

        scored = held.mapInArrow(rate, B.with_row(held, "text string, score double")).select(
            "row.*", F.col("text").alias(text), "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
