"""Toxicity scores by a weighted finite-state pattern grammar.

The words of a text are read as classes: insult, threat, target, negation,
reporting and other. Three small transducers look at them from left to right within
a clause: one remembers a negation for a few words, one that speech is reported,
one that somebody is addressed. Composed, they are one automaton whose insult and
threat arcs carry a factor; a matched word adds its weight times that factor to its
clause. A clause counts when something in it matched, so a text is judged by its
matched clauses, not by its words.

Which words insult and how much is learned: words that labelled toxic texts hold
and clean ones do not, by their log odds. A logistic function of a text's clause
scores, fitted on labelled rows that the word weights have not seen, is the score.
With few toxic rows both use the same rows.
Both use a bounded sample of the labelled rows (``sample`` of each label, by least
hash of the id). Words are compared by 64-bit names over whole texts, and only
clauses with a match are walked.

Edge cases: NULL and empty texts match nothing and get the score of clean texts.
Without toxic or clean training rows all scores are 0. Null ids match no label;
repeated rows are scored alike. Other columns stay; score and predicted are
replaced.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm import blocks as B
from lintmill.llm import words as W
from lintmill.session import materialize

SAMPLE = 20_000
ENTRIES = 20_000   # words a lexicon holds at most, the strongest
LEAST_TEXTS = 3    # toxic texts that a learned word occurs in, at every size; the smoothed log odds decide on the rest
LEAST_WEIGHT = 2.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Fixed word lists of the grammar.
LISTS = {
    INSULT: "idiot moron stupid fool loser scum trash worthless pathetic disgusting",
    THREAT: "kill hurt destroy burn shoot beat murder matar toeten tuer",
    TARGET: "you your youre u he she they him her them tu vous du ihr sie usted ustedes",
    NEGATION: "not no never isnt arent dont nicht kein keine pas jamais no nunca wasnt werent doesnt didnt cant wont",
    REPORT: "said says say told called wrote claimed quoted according sagte dit dijo",
}
LISTED_WEIGHTS = {INSULT: 4.0, THREAT: 1.0}
FEW = 150  # toxic training rows below which words and weights are fitted on the same rows

_SPACE = W.SPACE.copy()
_SPACE[[b for b in range(128) if not chr(b).isalnum()]] = True
_CONTRACTION = "(?i)(n)['’](t)\\b"  # isn't is the word isnt
_CLAUSE = np.isin(np.arange(256), np.frombuffer(b".!?;\n", np.uint8))


class Transducer:
    """States with arcs by class: arcs[state][class] = (next state, factor of a match)."""

    def __init__(self, arcs: list[list[tuple[int, float]]]):
        self.arcs = arcs

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: both read the same classes, factors multiply."""
        pairs = list(itertools.product(range(len(self.arcs)), range(len(other.arcs))))
        at = {p: i for i, p in enumerate(pairs)}
        return Transducer([
            [(at[a[0], b[0]], a[1] * b[1]) for a, b in zip(self.arcs[i], other.arcs[j], strict=True)] for i, j in pairs
        ])


def _remembers(trigger: int, span: int, factor: float) -> Transducer:
    """After ``trigger``, matches within ``span`` words count by ``factor``; state 0 is the start."""
    return Transducer([
        [(span if c == trigger else max(state - 1, 0), factor if state else 1.0) for c in range(6)]
        for state in range(span + 1)
    ])


def _keeps(trigger: int, factor: float) -> Transducer:
    """After ``trigger``, every later match of the clause counts by ``factor``."""
    return Transducer([[(int(s or c == trigger), factor if s else 1.0) for c in range(6)] for s in (0, 1)])


def grammar() -> Transducer:
    """Negation (four words), reported speech and a target (to the clause's end), composed."""
    return _remembers(NEGATION, 4, 0.4) @ _keeps(REPORT, 0.5) @ _keeps(TARGET, 1.5)


def _tokens(texts: pa.Array | pa.ChunkedArray) -> W.Words:
    texts = pc.replace_substring_regex(texts.cast(pa.large_string()), _CONTRACTION, r"\1\2")
    return W.split_words(texts, lower=True, space=_SPACE)


def fixed_names() -> tuple[np.ndarray, np.ndarray]:
    """Names of the listed words, sorted, and their classes."""
    listed = [(w, c) for c, ws in LISTS.items() for w in dict.fromkeys(ws.split())]
    names = _tokens(pa.array([w for w, _ in listed])).name
    names, first = np.unique(names, return_index=True)
    return names, np.array([c for _, c in listed])[first]


@dataclass
class Lexicon:
    names: np.ndarray    # sorted
    classes: np.ndarray
    weights: np.ndarray

    @classmethod
    def build(cls, learned: np.ndarray, weights: np.ndarray) -> Lexicon:
        fixed, kinds = fixed_names()
        new = ~np.isin(fixed, learned[weights >= 2 * LEAST_WEIGHT])
        fresh = ~np.isin(learned, fixed[new])
        names = np.concatenate([fixed[new], learned[fresh]])
        classes = np.concatenate([kinds[new], np.full(int(fresh.sum()), INSULT)])
        listed = np.array([LISTED_WEIGHTS.get(k, 0.0) for k in kinds[new]])
        held = np.concatenate([listed, weights[fresh]])
        order = np.argsort(names)
        return cls(names[order], classes[order], held[order])

    def look_up(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        found = self.names[at] == name
        return np.where(found, self.classes[at], OTHER), np.where(found, self.weights[at], 0.0)


def clause_scores(texts: pa.Array | pa.ChunkedArray, lexicon: Lexicon, automaton: Transducer) -> np.ndarray:
    """Per text: sum and maximum of its matched clauses' scores, matched clauses, log of words."""
    words = _tokens(texts)
    docs = len(words.first) - 1
    out = np.zeros((docs, 4))
    out[:, 3] = np.log1p(np.diff(words.first))
    classes, weights = lexicon.look_up(words.name)
    doc = words.doc_of_word()
    ends = np.append(0, np.cumsum(_CLAUSE[words.data]))
    clause = ends[words.start] + doc  # a document's end ends a clause too
    matched = (classes == INSULT) | (classes == THREAT)
    if not matched.any():
        return out
    walked = np.isin(clause, clause[matched])
    at = np.flatnonzero(walked)
    breaks = np.flatnonzero(np.diff(clause[at])) + 1
    for part in np.split(at, breaks):
        state, total = 0, 0.0
        for kind, weight in zip(classes[part].tolist(), weights[part].tolist(), strict=True):
            state, factor = automaton.arcs[state][kind]
            if kind in (INSULT, THREAT):
                total += weight * factor
        d = doc[part[0]]
        out[d, 0] += total
        out[d, 1] = max(out[d, 1], total)
        out[d, 2] += 1
    return out


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray

    def score(self, texts) -> np.ndarray:
        found = features(clause_scores(texts, self.lexicon, grammar()))
        return 1 / (1 + np.exp(-np.clip(found @ self.coefficients, -30, 30)))


def features(clauses: np.ndarray) -> np.ndarray:
    density = clauses[:, 0] / np.maximum(clauses[:, 3], 1)
    return np.stack([np.log1p(clauses[:, 0]), np.sqrt(clauses[:, 1]), np.log1p(clauses[:, 2]), density, np.ones(len(clauses))], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls."""
    weights = np.zeros(x.shape[1])
    bound = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])

    def loss(w: np.ndarray) -> float:
        return np.logaddexp(0, x @ w).sum() - y @ (x @ w) + w @ bound @ w / 2

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + bound @ weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + bound
        step = np.linalg.solve(bend, slope)
        before = loss(weights)
        while np.abs(step).max() >= 1e-6 and loss(weights - step) > before:
            step = step / 2
        if np.abs(step).max() < 1e-6:
            break
        weights -= step
    return weights


def _learned_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Names and log odds of words that toxic texts hold and clean ones do not."""

    def count(batches):
        for batch in batches:
            words = _tokens(batch["text"])
            pairs = np.stack([words.name.view(np.int64), words.doc_of_word()], 1)
            kept = np.unique(pairs, axis=0) if len(pairs) else pairs
            toxic = batch["label"].to_numpy(zero_copy_only=False)[kept[:, 1]] == 1
            names, place = np.unique(kept[:, 0], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(np.bincount(place, weights=toxic, minlength=len(names)).astype(np.int64)),
                 pa.array(np.bincount(place, minlength=len(names)).astype(np.int64))], ["name", "toxic", "texts"])

    totals = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    toxic, clean = totals[0], totals[1] - totals[0]
    odds = F.log((F.col("toxic") + 0.25) / (toxic + 0.5)) - F.log((F.col("texts") - F.col("toxic") + 0.25) / (clean + 0.5))
    found = (
        rows.mapInArrow(count, "name long, toxic long, texts long").groupBy("name")
        .agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))
        .filter(F.col("toxic") >= LEAST_TEXTS).withColumn("weight", odds).filter(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "name").limit(ENTRIES).select("name", "weight").collect()
    )
    return np.array([r.name for r in found], np.int64).view(np.uint64), np.array([r.weight for r in found], float)


def train(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text",
    label: str = "toxic", sample: int = SAMPLE,
) -> Model | None:
    """Lexicon from two thirds of the training rows, clause weights from the other third."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label).alias("label"), held_out.alias("held_out"))
    known = known.filter("id is not null and label is not null and not held_out").groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.filter("label = 1").orderBy(*order).limit(sample).unionByName(known.filter("label = 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = materialize(  # at most twice the sample
        texts.join(F.broadcast(chosen), "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3))), "labelled"
    )
    found = rows.groupBy().agg(F.sum("label"), F.count(F.lit(1))).first()
    if not found[0] or found[0] == found[1]:
        return None
    few = found[0] < FEW
    seen, unseen = (rows, rows) if few else (rows.filter("fold < 2"), rows.filter("fold = 2"))
    lexicon = Lexicon.build(*_learned_words(seen.select("text", "label")))
    automaton = grammar()

    def measure(batches):
        for batch in batches:
            x = features(clause_scores(batch["text"], lexicon, automaton))
            yield pa.RecordBatch.from_arrays([batch["label"].cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    fitted = unseen.select("text", "label").mapInArrow(measure, "label long, x binary").orderBy("x", "label").collect()
    x = np.array([np.frombuffer(r.x) for r in fitted]).reshape(len(fitted), -1)
    y = np.array([r.label for r in fitted], float)
    if not len(y) or y.min() == y.max():
        return None
    # The sample may hold fewer of one label than there are: weigh them back.
    coefficients = logistic(x, y)
    shares = known.agg(F.avg("label")).first()[0]
    coefficients[-1] += np.log(shares / (1 - shares)) - np.log(found[0] / (found[1] - found[0]))
    return Model(lexicon, coefficients)


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score and predicted to every row."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    if model is None:
        scored = docs.select(*[f"`{c}`" for c in kept]).withColumn("score", F.lit(0.0))
    else:
        held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text]).alias("row"), F.col(f"`{text}`").alias("text"))

        def rate(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    yield pa.RecordBatch.from_arrays([part["row"], part["text"], pa.array(model.score(part["text"]))], ["row", "text", "score"])

        scored = held.mapInArrow(rate, B.with_row(held, "text string, score double")).select("row.*", F.col("text").alias(text), "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
