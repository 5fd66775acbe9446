"""Operator 1: near-duplicate documents by SetSketch registers.

Method.  A document is its set of distinct k-word shingles.  Its sketch
(Ertl, 2021) has m registers; register i holds floor(1 - log_b x), clipped to
[0, q + 1], of the smallest x over the set, x being exponentially distributed
with rate a by hash i.  Registers of a union are the maxima, so sketches merge;
with b near 1 two registers agree with probability close to the Jaccard
similarity, so bands of registers are locality-sensitive.  Documents with equal
sets are one item.  Pairs that share a band are estimated jointly by maximum
likelihood from the numbers of larger, smaller and equal registers and the known
set sizes; pairs whose estimate is far under the threshold go, all others are
confirmed on their full shingle sets (see ``linking``).

Defined cases.  Null, empty or blank texts have the empty set (size 0), are
linked with nothing and form components of their own.  Texts of 1 to k-1 words
are one shingle.  Equal texts and ties share the smallest doc_id.  Rows are told
apart by numbers of their own: rows of one doc_id with different texts are linked
each by its own set, and so are rows whose doc_id is null; a component is named by
its smallest doc_id, and has none if all its rows are null.  Extra columns are
ignored; an empty table gives an empty result.

Scale.  One pass over the text gives 128 + 8 m / 4 bytes a document; everything
after works on that, except for the sets of documents that share a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T
from talkweave.llm.linking import link
from talkweave.llm.tables import Scratch, fresh, small

WORDS = 5
PERCENT = 85
BANDS, ROWS = 16, 4
REGISTERS = BANDS * ROWS
#: Sketch parameters: base, rate and limit of the registers.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Standard deviations under the threshold at which an estimate rules a pair out.
MARGIN = 5.0


def _constants() -> tuple[np.ndarray, np.ndarray]:
    r = T.mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
    return (r[:REGISTERS] >> np.uint64(32)).astype(np.uint32), (r[REGISTERS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def registers(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The sketch of each row's hashes: uint16, one line per row, zeros for empty rows."""
    out = np.zeros((len(number), REGISTERS), np.uint16)
    full = np.flatnonzero(number)
    if not len(full):
        return out
    starts = np.cumsum(number)[full] - number[full]
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(full)), np.uint32)
    room = np.empty_like(low)
    for i, (s, m) in enumerate(zip(*_constants(), strict=True)):
        np.bitwise_xor(low, s, out=room)
        np.multiply(room, m, out=room)
        np.minimum.reduceat(room, starts, out=least[i])
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
    return out


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row of lower-cased text, and their number."""
    data = T.LOWER[data]
    start, end, counts = T.words(data, at)
    return T.distinct(*T.shingles(T.Spans(data).hash(start, end), counts, words))


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, size, d1, d2, signature) of every row: set size, a 128-bit digest of the set, and the registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                h, number = shingle_sets(data, at, words)
                at_row = np.concatenate([[0], np.cumsum(number)])
                digests = []
                for salt in T.BASES:
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h ^ salt))])
                    digests.append((sums[at_row[1:]] - sums[at_row[:-1]]).view(np.int64))
                reg = registers(h, number)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_hash"], pa.array(number.astype(np.int64)), *map(pa.array, digests), T.binaries(reg.ravel(), np.full(len(number), REGISTERS))],
                    ["doc_id", "text_hash", "size", "d1", "d2", "signature"],
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(sketch, "doc_id long, text_hash long, size long, d1 long, d2 long, signature binary")


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, members): the sorted distinct shingle hashes of each row as bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["id"], T.binaries(*shingle_sets(data, at, words))], ["id", "members"])

    return docs.select("id", "text").mapInArrow(build, "id long, members binary")


def similarity(size_a: np.ndarray, size_b: np.ndarray, sig_a: np.ndarray, sig_b: np.ndarray, steps: int = 64) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and set sizes, on a grid refined once."""
    larger, smaller = (sig_a > sig_b).sum(1), (sig_a < sig_b).sum(1)
    equal = sig_a.shape[1] - larger - smaller
    u = size_a / (size_a + size_b)
    top = np.minimum(u / (1 - u), (1 - u) / u)

    def best(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, steps)
        p = [-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE) for x in (u[:, None] - (1 - u)[:, None] * j, (1 - u)[:, None] - u[:, None] * j)]
        logs = [np.log(np.maximum(x, 1e-12)) for x in (*p, 1 - p[0] - p[1])]
        k = (larger[:, None] * logs[0] + smaller[:, None] * logs[1] + equal[:, None] * logs[2]).argmax(1)
        return j[np.arange(len(j)), k], (high - low) / (steps - 1)

    j, step = best(np.zeros(len(u)), top)
    return best(np.maximum(j - step, 0), np.minimum(j + step, top))[0]


def possible(percent: int):
    """The test that sizes and sketches allow the threshold, with MARGIN standard deviations to spare.

    The log-likelihood is concave in the similarity, so that its greatest value lies at
    ``least`` or over it if it doesn't fall there: one slope a pair instead of a search.
    """
    t = percent / 100
    least = t - MARGIN * np.sqrt(t * (1 - t) / REGISTERS)
    c = (BASE - 1) / BASE

    def test(size_a: np.ndarray, size_b: np.ndarray, sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
        where = np.flatnonzero(ok)
        if len(where) < len(ok):
            size_a, size_b, sig_a, sig_b = size_a[where], size_b[where], sig_a[where], sig_b[where]
        larger, smaller = T.true_bits(sig_a > sig_b), T.true_bits(sig_a < sig_b)
        u = size_a / (size_a + size_b)
        v = 1 - u
        left = (1 - c * (u - v * least), 1 - c * (v - u * least))
        p = [-np.log(x) / np.log(BASE) for x in left]  # over 0, as sizes allow more than ``least``
        fall = (v / left[0], u / left[1])
        ok[where] = (REGISTERS - larger - smaller) * (fall[0] + fall[1]) / (1 - p[0] - p[1]) >= larger * fall[0] / p[0] + smaller * fall[1] / p[1]
        return ok

    return test


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(_row, doc_id, text_hash, n_shingles, root) of every row: rows of one root are one component.

    docs: doc_id, text.  _row numbers the rows as they are sketched.  Rows without a shingle have no root.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    sketched = scratch.save(sketches(docs, words).withColumn("_row", F.monotonically_increasing_id()), "sketches")
    key = ["size", "d1", "d2"]
    classes = scratch.save(sketched.where("size > 0").groupBy(*key).agg(F.min("_row").alias("id"), F.first("signature").alias("signature")), "classes")
    width = 2 * ROWS
    buckets = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(BANDS)])
    items = classes.select("id", "size", "signature", buckets.alias("buckets"))

    def sets_of(ids: DataFrame) -> DataFrame:
        places = sketched.select(F.col("_row").alias("id"), F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).join(small(ids), "id")
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))
        return sets(docs.join(small(scratch.save(places, "places")), same), words)

    roots = link(items, sets_of, possible(percent), np.dtype(np.uint16), percent, scratch)
    named = classes.select(*key, "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select(*key, F.coalesce("root", "id").alias("root"))
    out = sketched.select("_row", "doc_id", "text_hash", *key).join(named, key, "left")
    return scratch.finish(out.select("_row", "doc_id", "text_hash", F.col("size").alias("n_shingles"), "root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row's (doc_id, n_shingles, component_id, kept) under Jaccard similarity of word shingles.

    docs: doc_id, text.  component_id is the smallest doc_id of the row's component, kept marks the rows that have it.
    """
    found = components(docs, words, percent)
    names = found.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = found.join(names, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicate rows: that of the smallest doc_id, null last; unlinked rows all stay.

    Rows of one doc_id and text are equal here, so any one of them may stay.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    keys = components(docs, words, percent).where("root IS NOT NULL").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    doc, text, stays = fresh(docs, "_doc", "_text", "_stays")
    best = keys.groupBy("root").agg(F.count("*").alias("keys"), F.min(rank).alias("best"))
    judged = keys.join(best, "root").withColumn("stays", rank == F.col("best"))
    # rows that go, and those that stay once; all others need no mention
    special = scratch.save(judged.where("NOT stays OR n > 1").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("stays").alias(stays)), "special")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text))
    told = docs.join(small(special), same, "left")
    once = told.where(F.col(stays)).dropDuplicates([doc, text])
    return told.where(F.col(stays).isNull()).unionByName(once).select(docs.columns)
