"""Operator 8: quality scores by nearest-neighbour voting in a latent-semantic space.

Method.  A text is a bag of features: byte trigrams as written, words' shapes, and
marks of its form (length, repeated words and lines, capitals, punctuation), hashed
to 2**BITS columns, with 1 + log counts, inverse document frequency and unit length.
A truncated singular value decomposition of the labelled rows' matrix gives DIMS
latent directions.  The labelled rows' latent vectors are broadcast; every text is
folded in and compared with all of them by exact cosine products in blocks, and the
NEIGHBOURS nearest vote with their labels, weighted by a power of similarity.

Training.  Labels come from rows whose crc32(doc_id as text) mod 5 is not 0; at most
about SAMPLE of these, chosen by a hash of doc_id (a documented bound), are used.
Labels, lang, source and doc_id are never inputs.

Defined cases.  A null or empty text has only marks of its form, and is compared by
them.  Null labels are not learnt from.  Without any label every score is 0.5.
Repeated rows score alike; extra columns are ignored.  Ties among neighbours go to
the smaller doc_id.

Scale.  Scoring is one scan without a shuffle; SAMPLE * DIMS and 2**BITS * DIMS
floats are broadcast whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T
from talkweave.llm.toxicity import held_out, sample_of

BITS = 15
DIMS = 48
SAMPLE = 6_000
NEIGHBOURS = 25
POWER = 4.0
THRESHOLD = 0.3
BLOCK = 512
#: Bins of each mark of form; MARKS columns follow the hashed ones.
BINS = 12
FORMS = 7
MARKS = BINS * FORMS
WIDTH = (1 << BITS) + MARKS
#: Weight of the marks of form against the trigrams.
FORM_WEIGHT = 12.0


def _bin(share: np.ndarray) -> np.ndarray:
    return np.clip((share * BINS).astype(np.int64), 0, BINS - 1)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of each text's distinct features."""
    n = len(at) - 1
    size = np.diff(at)
    row_of = np.repeat(np.arange(n), size)
    rows, columns, counts = [], [], []
    if len(data) >= 3:
        key = (data[:-2].astype(np.uint64) << np.uint64(16)) | (data[1:-1].astype(np.uint64) << np.uint64(8)) | data[2:]
        ok = row_of[:-2] == row_of[2:]
        column = (T.mix(key[ok]) >> np.uint64(64 - BITS)).astype(np.int64)
        pair, number = np.unique(row_of[:-2][ok] * (1 << BITS) + column, return_counts=True)
        rows.append(pair >> BITS), columns.append(pair & ((1 << BITS) - 1)), counts.append(1 + np.log(number))
    start, end, words = T.words(data, at)
    hashes = T.Spans(data).hash(start, end)
    distinct = T.distinct(hashes, words)[1]
    newline = np.zeros(256, bool)
    newline[0x0A] = True
    ls, le, lines = T.words(data, at, newline)
    distinct_lines = T.distinct(T.Spans(data).hash(ls, le), lines)[1]
    starts_row = np.repeat(np.arange(n), words)
    letters = (data >= 0x41) & (data <= 0x5A)
    marks = (data < 0x80) & (data > 0x20) & ~letters & ~((data >= 0x61) & (data <= 0x7A)) & ~((data >= 0x30) & (data <= 0x39))
    digits = (data >= 0x30) & (data <= 0x39)
    repeated = np.zeros(len(hashes), bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (starts_row[1:] == starts_row[:-1])
    one, each = np.maximum(size, 1), np.maximum(words, 1)
    forms = [
        np.minimum(np.log2(1 + words) / 16, 0.999),
        distinct / each,
        np.bincount(row_of, letters, n) / one * 2,
        np.sqrt(np.bincount(row_of, marks, n) / one),
        np.sqrt(np.bincount(row_of, digits, n) / one),
        np.sqrt(np.bincount(starts_row, repeated, n) / each),
        distinct_lines / np.maximum(lines, 1),
    ]
    for k, form in enumerate(forms):
        rows.append(np.arange(n)), columns.append((1 << BITS) + k * BINS + _bin(form)), counts.append(np.full(n, FORM_WEIGHT))
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(counts)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # WIDTH x DIMS
    vectors: np.ndarray  # labelled rows x DIMS, of unit length
    labels: np.ndarray

    def fold(self, row: np.ndarray, column: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Latent unit vectors of n texts."""
        value = count * self.idf[column]
        norm = np.sqrt(np.maximum(np.bincount(row, value**2, n), 1e-12))
        order = np.argsort(row, kind="stable")
        row, column, value = row[order], column[order], (value / norm[row])[order].astype(np.float32)
        starts = np.searchsorted(row, np.arange(n))
        out = np.empty((n, self.basis.shape[1]), np.float32)
        for a in range(0, n, 64):
            b = min(a + 64, n)
            low, high = starts[a], starts[b] if b < n else len(row)
            out[a:b] = np.add.reduceat(self.basis[column[low:high]] * value[low:high, None], starts[a:b] - low, 0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled rows, in blocks of texts."""
        if not len(self.labels):
            return np.full(len(vectors), 0.5)
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(vectors))
        for a in range(0, len(vectors), BLOCK):
            cosine = vectors[a : a + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            border = np.take_along_axis(cosine, near, 1).min(1)
            for i in np.flatnonzero((cosine >= border[:, None]).sum(1) > k):  # ties at the border go to the smaller doc_id
                near[i] = np.lexsort((np.arange(cosine.shape[1]), -cosine[i]))[:k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** POWER
            out[a : a + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def fit(row: np.ndarray, column: np.ndarray, count: np.ndarray, labels: np.ndarray) -> Model:
    """Frequencies, latent directions by a randomized decomposition, and the labelled rows' vectors."""
    n = len(labels)
    if not n:
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    idf = (np.log((1 + n) / (1 + np.bincount(column, minlength=WIDTH))) + 1).astype(np.float32)
    value = count * idf[column]
    norm = np.sqrt(np.maximum(np.bincount(row, value**2, n), 1e-12))
    value = (value / norm[row]).astype(np.float32)
    by_row, by_column = np.argsort(row, kind="stable"), np.argsort(column, kind="stable")

    def product(index: np.ndarray, to: np.ndarray, of: np.ndarray, size: int, dense: np.ndarray) -> np.ndarray:
        """Sparse times dense: rows ``to`` collect value * dense[of]; index sorts by ``to``."""
        out = np.zeros((size, dense.shape[1]), np.float32)
        for a in range(0, len(index), 1 << 18):
            i = index[a : a + (1 << 18)]
            cut = np.flatnonzero(np.diff(to[i], prepend=-1))
            out[to[i][cut]] += np.add.reduceat(dense[of[i]] * value[i, None], cut, 0)
        return out

    dims = max(1, min(DIMS, n - 1))
    basis = np.random.default_rng(0).normal(size=(WIDTH, dims + 8)).astype(np.float32)
    for _ in range(3):
        left = np.linalg.qr(product(by_row, row, column, n, basis))[0]
        basis = np.linalg.qr(product(by_column, column, row, WIDTH, left))[0]
    image = product(by_row, row, column, n, basis)
    basis = (basis @ np.linalg.svd(image, full_matrices=False)[2].T)[:, :dims].astype(np.float32)
    model = Model(idf, np.ascontiguousarray(basis), np.zeros((0, dims), np.float32), labels)
    model.vectors = model.fold(row, column, count, n)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """The model of the labelled rows outside the held-out fold."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                row, column, count = features(data, at)
                order = np.argsort(row, kind="stable")
                number = np.bincount(row, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], T.binaries(column[order].astype(np.int32), number), T.binaries(count[order].astype(np.float32), number)], ["doc_id", "label", "columns", "counts"])

    rows = sample_of(docs, labels, label, most).mapInArrow(extract, "doc_id long, label double, columns binary, counts binary").toPandas().sort_values(["doc_id", "label"])
    columns = [np.frombuffer(x, np.int32) for x in rows["columns"]]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in columns])
    return fit(row, np.concatenate([np.zeros(0, np.int32), *columns]), np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(x, np.float32) for x in rows["counts"]]]), rows["label"].to_numpy())


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's (doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                p = fitted.scores(fitted.fold(*features(data, at), part.num_rows))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(p)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
