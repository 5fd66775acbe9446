"""Operator 11: language identification by averaged hashed subword embeddings.

Method.  A text is its byte n-grams of the lengths ORDERS, lower-cased, with white space
for all ASCII but letters, so that n-grams tell where words begin and end.  Each is
hashed to one of 2**BITS embeddings of DIMS numbers; the text's vector is their
average, and a linear softmax over it gives a probability for every learned language.
Embeddings and softmax are trained together by stochastic gradient descent in numpy.

Calibration.  Every FOLD-th row of the sample is kept from training.  On these rows a
temperature is fitted (least log loss), and the threshold of rejection is the
lowest score down to which at most ERROR of the accepted rows are wrong; ``rejected``
marks texts that score less.

Training.  Labels are ``lang`` where not null, of rows whose crc32(doc_id as text) mod 3
is not 1; at most about SAMPLE rows of each language (a documented bound), chosen by a hash
of doc_id, whole texts each.  lang, source and doc_id are never inputs of a prediction.

Defined cases.  A null text, or one without a letter, is ``und`` with score 0, and so
is every text if nothing was learned.  Rows whose doc_id is null are not learned from and
not held out.  Repeated rows score alike.  Equal scores go to the first language by
name.  Extra columns are ignored; an empty table gives an empty result.

Scale.  Scoring is one scan without a shuffle; 2**BITS rows of one number per language,
or of DIMS for many languages, are broadcast whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T

ORDERS = (2, 3, 4)
BITS = 16
DIMS = 16
SAMPLE = 500
FOLD = 5
ERROR = 0.005
EPOCHS, BATCH, RATE = 12, 16, 1.0
SPACE = 0x20
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[[c for c in range(128) if not chr(c).isalpha()]] = True


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram, in order of row; a text stands between two spaces."""
    n = len(at) - 1
    text = np.full(len(data) + n + 1, SPACE, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(at))
    text[np.arange(len(data)) + owner + 1] = np.where(NOT_LETTER[data], np.uint8(SPACE), T.LOWER[data])
    row = np.repeat(np.arange(n), np.diff(at) + 1)  # the space before a text is its own
    stop = (at[1:] + np.arange(1, n + 1))[row]
    rows, buckets = [], []
    key = text.astype(np.uint64)
    place = np.arange(len(row))
    for k in range(1, max(ORDERS)):
        key = (key[:-1] << np.uint64(8)) | text[k:]
        if k + 1 in ORDERS:
            m = min(len(row), len(key))
            ok = (place[:m] + k <= stop[:m]) & ((text[:m] != SPACE) | (text[1 : m + 1] != SPACE))
            rows.append(row[:m][ok])
            buckets.append((T.mix(key[:m][ok] + (np.uint64(k) << np.uint64(40))) >> np.uint64(64 - BITS)).astype(np.int64))
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray  # 2**BITS x DIMS
    output: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def table(self) -> np.ndarray:
        """What is averaged: each bucket's share of the logits, or its embedding where that is shorter."""
        return self.embeddings @ self.output if len(self.languages) <= DIMS else self.embeddings

    def probabilities(self, averages: np.ndarray) -> np.ndarray:
        logits = (averages if len(self.languages) <= DIMS else averages @ self.output) + self.bias
        logits = logits / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def averages(table: np.ndarray, row: np.ndarray, bucket: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The mean row of a table over each text's n-grams; zeros for texts without any."""
    out = np.zeros((n, table.shape[1]))
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    weight = np.ones(len(row)) if weight is None else weight
    for k in range(table.shape[1]):
        out[row[first], k] = np.add.reduceat(table[bucket, k] * weight, first) if len(first) else 0
    return out / np.maximum(np.bincount(row, weight, n), 1)[:, None]


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str]) -> Model:
    """Stochastic gradient descent on the log loss; texts: distinct buckets and their counts."""
    rng = np.random.default_rng(11)
    e = rng.uniform(-1, 1, (1 << BITS, DIMS)) / DIMS
    w, bias = rng.uniform(-1, 1, (DIMS, len(languages))) / DIMS, np.zeros(len(languages))
    held = np.arange(len(texts)) % FOLD == FOLD - 1
    learned = np.flatnonzero(~held)
    steps, done = EPOCHS * -(-len(learned) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(learned)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            bucket = np.concatenate([texts[i][0] for i in rows])
            row = np.repeat(np.arange(len(rows)), [len(texts[i][0]) for i in rows])
            share = np.concatenate([texts[i][1] / max(texts[i][1].sum(), 1) for i in rows])
            hidden = np.zeros((len(rows), DIMS))
            for f in range(DIMS):
                hidden[:, f] = np.bincount(row, e[bucket, f] * share, len(rows))
            logits = hidden @ w + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = p / p.sum(1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            rate = RATE * (1 - done / steps)
            back = error @ w.T
            touched, inverse = np.unique(bucket, return_inverse=True)
            for f in range(DIMS):
                e[touched, f] -= rate * np.bincount(inverse, back[row, f] * share, len(touched))
            w -= rate * hidden.T @ error
            bias -= rate * error.sum(0) / len(rows)
            done += 1
    model = Model(languages, e.astype(np.float32), w.astype(np.float32), bias)
    return calibrated(model, [texts[i] for i in np.flatnonzero(held)], labels[held])


def calibrated(model: Model, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """The model with temperature and threshold fitted on rows that it hasn't learned from."""
    if not len(texts):
        return model
    row = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
    table = averages(model.table(), row, np.concatenate([t[0] for t in texts]), len(texts), np.concatenate([t[1] for t in texts]))

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return float(-np.log(np.maximum(model.probabilities(table)[np.arange(len(labels)), labels], 1e-300)).mean())

    model.temperature = min(np.geomspace(0.05, 20, 61).tolist(), key=loss)
    p = model.probabilities(table)
    score, wrong = p.max(1), p.argmax(1) != labels
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(wrong[order]) <= ERROR * np.arange(1, len(order) + 1))
    model.threshold = float(score[order[good[-1]]]) if len(good) else 1.0
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, most: int = SAMPLE) -> Model:
    """The model of the languages of labelled rows outside the held-out fold.

    docs: doc_id, text, lang.
    """
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1, DIMS), np.float32), np.zeros((DIMS, 0), np.float32), np.zeros(0))
    limits = docs.sparkSession.createDataFrame([(lang, min(1_000_003, 1_000_003 * most // n)) for lang, n in counts.items()], "lang string, most long")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                row, bucket = grams(data, at)
                key, count = np.unique((row << BITS) | bucket, return_counts=True)
                number = np.bincount(key >> BITS, minlength=len(part))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["lang"], T.binaries((key & ((1 << BITS) - 1)).astype(np.int32), number), T.binaries(count.astype(np.int32), number)], ["doc_id", "lang", "buckets", "counts"])

    some = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("most")).select("doc_id", "lang", "text")
    found = some.mapInArrow(features, "doc_id long, lang string, buckets binary, counts binary").toPandas().sort_values(["doc_id", "lang", "buckets"])
    texts = [tuple(np.frombuffer(x, np.int32).astype(np.int64) for x in pair) for pair in zip(found["buckets"], found["counts"], strict=True)]
    return fit(texts, np.searchsorted(np.array(languages), found["lang"].to_numpy(str)), languages)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's (doc_id, held_out, lang_pred, score, rejected).

    docs: doc_id, text.  rejected: the score is under the calibrated threshold, or there is nothing to judge.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        table, names = fitted.table(), np.array([*fitted.languages, "und"], object)
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                best, top = np.full(len(part), len(fitted.languages)), np.zeros(len(part))
                if fitted.languages:
                    row, bucket = grams(data, at)
                    p = fitted.probabilities(averages(table, row, bucket, len(part)))
                    some = part["letters"].to_numpy(zero_copy_only=False)
                    best[some], top[some] = p.argmax(1)[some], p.max(1)[some]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(names[best], pa.string()), pa.array(top), pa.array((best == len(fitted.languages)) | (top < fitted.threshold))], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters.alias("letters"))
    scored = rows.mapInArrow(score, "doc_id long, lang_pred string, score double, rejected boolean")
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
