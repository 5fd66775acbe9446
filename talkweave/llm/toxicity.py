"""Operator 6: toxicity scores by a factorization machine over hashed terms.

Method (Rendle, 2010).  A text is the set of its distinct lower-cased words and
their first STEMS bytes, hashed to 2**BITS terms.  The score is the logistic of a bias, a weight of each
term, and the inner products of the terms' factor vectors over all pairs of
terms, which learn what an additive model misses, such as an insult that matters
together with a mention of a group.  The pair sum costs one pass:
half of |sum of vectors|^2 minus the sum of |vectors|^2.  To keep long texts on
the scale of short ones, the pair sum is divided by the number of terms.

Training.  Labels come from rows whose crc32(doc_id as text) mod 5 is not 0.  At
most about SAMPLE of these are used, chosen by a hash of doc_id (a documented
bound); their term ids, not their texts, come to the driver, which fits the model
by AdaGrad in a fixed order.  Terms that are strong alone are fitted first; from
there the weights and factors of all terms are fitted, factors with a pull to 0 (L2)
and weights with one to where they began (L1).  So rare terms and pairs
whose parts are neutral alone are learnt from the rows that strong terms don't explain.
Labels, lang, source and doc_id are never inputs.

Defined cases.  A null, empty or wordless text gets the score of the bias alone.
Rows without labels, with null labels or labelled twice: null labels are not
learnt from, and of repeated rows of one doc_id one teaches.  Without any label all
scores are UNTRAINED, below the threshold.  Repeated rows score alike; extra columns are ignored or carried.

Scale.  Scoring is one scan without a shuffle; the model, 2**BITS * (1 + FACTORS)
floats whatever the corpus, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T

BITS = 18
FACTORS = 4
#: Leading bytes of a word that are terms too.
STEMS = (6, 8)
SAMPLE = 12_000
#: Terms whose share of labelled rows differs between the labels by so many standard deviations are fitted first.
SIGNIFICANT = 4.0
EPOCHS = 20
BATCH = 64
RATE = 0.3
#: Pull of each touched weight to 0, of the loss's sum over a batch.
DECAY = 0.005
#: The fit of all terms: passes, step of the weights, and their L1 pull.
ALL_EPOCHS = 20
ALL_RATE = 0.01
LASSO = 0.2
THRESHOLD = 0.5

#: The score of every text where there are no labels.
UNTRAINED = 0.25
#: ASCII other than letters and digits separates words.
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[c for c in range(128) if not chr(c).isalnum()]] = True


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    trained: bool = True

    def logits(self, terms: np.ndarray, number: np.ndarray) -> np.ndarray:
        """One logit per row of distinct terms."""
        full = np.flatnonzero(number)
        out = np.full(len(number), self.bias)
        if len(full):
            starts = (np.cumsum(number) - number)[full]
            out[full] += np.add.reduceat(self.weights[terms], starts)
            v = self.factors[terms]
            total = np.add.reduceat(v, starts, 0)
            out[full] += 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), starts)) / number[full]
        return out


def term_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row, and their number."""
    data = T.LOWER[data]
    start, end, counts = T.words(data, at, IS_SEPARATOR)
    spans = T.Spans(data)
    # a word and its stems, told apart by the span's length in the hash
    each = [(start, end)] + [(start, np.minimum(start + k, end)) for k in STEMS]
    unused = np.uint64(64 - BITS)
    hashes = np.stack([spans.hash(*x) for x in each], 1) >> unused << unused
    terms, number = T.distinct(hashes.ravel(), counts * len(each))
    return terms >> unused, number


def fit(terms: np.ndarray, number: np.ndarray, labels: np.ndarray) -> Model:
    """The model of all terms, started from that of the terms that are strong alone."""
    first = fit_strong(terms, number, labels)
    return fit_all(first, terms, number, labels) if first.trained else first


def fit_all(first: Model, terms: np.ndarray, number: np.ndarray, labels: np.ndarray) -> Model:
    """AdaGrad over all terms from a given model; rows without a term teach only the bias, which stays."""
    rng = np.random.default_rng(1)
    w, v = first.weights.astype(float), first.factors.astype(float)
    new = (v == 0).all(1)
    v[new] = rng.normal(0, 0.02, (new.sum(), FACTORS))
    begin, gw, gv = w.copy(), np.ones(len(w)), np.ones(v.shape)
    at = np.concatenate([[0], np.cumsum(number)])
    full = np.flatnonzero(number)
    for _ in range(ALL_EPOCHS):
        order = rng.permutation(full)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            n = number[rows]
            starts = np.cumsum(n) - n
            ids = terms[np.repeat(at[rows] - starts, n) + np.arange(n.sum())]
            row = np.repeat(np.arange(len(rows)), n)
            x = v[ids]
            total = np.add.reduceat(x, starts, 0)
            squares = np.add.reduceat((x**2).sum(1), starts)
            logit = first.bias + np.add.reduceat(w[ids], starts) + 0.5 * ((total**2).sum(1) - squares) / n
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]
            touched, inverse = np.unique(ids, return_inverse=True)
            dw = np.bincount(inverse, error[row], len(touched))
            pull = (error / n)[row, None] * (total[row] - x)
            dv = np.stack([np.bincount(inverse, pull[:, f], len(touched)) for f in range(FACTORS)], 1) + DECAY * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            step = ALL_RATE / np.sqrt(gw[touched])
            moved = w[touched] - step * dw - begin[touched]
            w[touched] = begin[touched] + np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
    seen = np.bincount(terms, minlength=len(w)) > 0
    return Model(first.bias, w.astype(np.float32), (v * seen[:, None]).astype(np.float32))


def fit_strong(terms: np.ndarray, number: np.ndarray, labels: np.ndarray) -> Model:
    """AdaGrad on the logistic loss over terms that are strong alone; rows in an order drawn once."""
    if not len(labels):
        return Model(float(np.log(UNTRAINED / (1 - UNTRAINED))), np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32), False)
    rng = np.random.default_rng(0)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    w, v = np.zeros(1 << BITS), rng.normal(0, 0.02, (1 << BITS, FACTORS))
    gw, gv, bias, gb = np.ones(1 << BITS), np.ones((1 << BITS, FACTORS)), float(np.log(share / (1 - share))), 1.0
    row = np.repeat(np.arange(len(number)), number)
    rows_with = np.bincount(terms, minlength=1 << BITS)
    toxic_with = np.bincount(terms, labels[row], 1 << BITS)
    expected = rows_with * share
    frequent = (np.abs(toxic_with - expected) >= SIGNIFICANT * np.sqrt(rows_with * share * (1 - share) + 1))[terms]
    sizes, terms, number = number, terms[frequent], np.bincount(row[frequent], minlength=len(number))
    v[np.bincount(terms, minlength=1 << BITS) == 0] = 0
    at = np.concatenate([[0], np.cumsum(number)])
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            n = number[rows]
            ids = terms[np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            row = np.repeat(np.arange(len(rows)), n)
            x = v[ids]
            total = np.zeros((len(rows), FACTORS))
            np.add.at(total, row, x)
            squares = np.bincount(row, (x**2).sum(1), len(rows))
            per = np.maximum(sizes[rows], 1)
            logit = bias + np.bincount(row, w[ids], len(rows)) + 0.5 * ((total**2).sum(1) - squares) / per
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]
            touched, inverse = np.unique(ids, return_inverse=True)
            dw = np.bincount(inverse, error[row], len(touched)) + DECAY * w[touched]
            dv = np.zeros((len(touched), FACTORS))
            np.add.at(dv, inverse, (error / per)[row, None] * (total[row] - x))
            dv += DECAY * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
            gb += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(gb)
    return Model(float(bias), w.astype(np.float32), v.astype(np.float32))


def held_out(doc_id) -> F.Column:  # noqa: ANN001
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of about ``most`` labelled training rows, chosen by a hash of doc_id; all if there are fewer."""
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id"), F.col(label).cast("double").alias("label"))
    number = wanted.count()
    if number > most:
        wanted = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * most / number))
    # repeated rows of one doc_id, here or there, teach once
    return docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("row")).select("doc_id", "row.*")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """The model of the labelled rows outside the held-out fold."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                terms, number = term_sets(data, at)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], T.binaries(terms.astype(np.uint32), number)], ["doc_id", "label", "terms"])

    rows = sample_of(docs, labels, label, most).mapInArrow(features, "doc_id long, label double, terms binary").toPandas().sort_values(["doc_id", "label"])
    sets = [np.frombuffer(x, np.uint32) for x in rows["terms"]]
    return fit(np.concatenate([np.zeros(0, np.uint32), *sets]).astype(np.int64), np.array([len(x) for x in sets], np.int64), rows["label"].to_numpy())


def _probabilities(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    terms, number = term_sets(data, at)
    return 1 / (1 + np.exp(-np.clip(model.logits(terms.astype(np.int64), number), -700, 700)))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's (doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(_probabilities(fitted, data, at))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that aren't predicted toxic, each judged by its own text as it passes through."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                yield part.filter(pa.array(_probabilities(fitted, data, at) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
