"""Operator 12: ranked lexical search over postings in geometric blocks.

Scores are inner products of whole numbers: an item's weight of a term (its inverse
document frequency, times its repeats) with a document's impact of it, tf against
length.  N, L and df are counted over all documents first.

Method.  Documents are searched in shards.  In a shard every term that an item asks
for has a posting list, clustered by the similarity of its documents (nearest of
pivots from the list itself, by cosine of random projections of the impact vectors)
to blocks.  A block stores the coordinatewise maximum of its documents' impacts, so
its product with an item bounds the score of every document in it.  An item visits
its terms in falling order of what they can add.  It stops when all terms that are left can't add
up to the worst of its best ``k`` so far, skips a block whose bound is under
that score, and scores the other blocks' documents in full.  Bounds are exact whole
numbers and a tie is never skipped, so results are those of scoring everything.

A shard's lists hold the terms that some item of the set asks for; the others add
nothing to any score.  Items are taken in sets of about ITEM_TERMS terms, each a
pass over the documents, so what is broadcast is bounded.  The best scores within one row in
SEED, chosen by a hash, are the first lower bounds in all shards: they only save work.

Defined cases.  Null texts and texts without a term are no documents and count in
neither N nor L; an item without terms has no rows.  Rows that repeat a doc_id are
documents of their own, and so are items that repeat an item_id.  Equal scores go by
ascending doc_id, null last.  Fewer than ``k`` documents with a score above 0: all of
them.  Extra columns are ignored; empty tables give an empty result.  Terms are told
apart by 64 bits of a hash.

Scale.  One scan of the documents per set of items writes only the counts of terms
asked for; searching shuffles at most ``k`` rows an item and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave.llm import text as T
from talkweave.llm.tables import Scratch

TOP = 20
#: Distinct terms of the items that are searched in one pass, about.
ITEM_TERMS = 1 << 16
#: Cells (documents times terms) of a shard.
CELLS = 1 << 24
#: Documents of a block, on average.
BLOCK = 32
#: Random directions that cluster a list.
DIRECTIONS = 8
#: One row in so many gives the first lower bounds.
SEED = 32
#: ASCII other than letters and digits separates terms.
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[c for c in range(128) if not chr(c).isalnum()]] = True


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each term, repeats included, and the number of each row's terms."""
    data = T.LOWER[data]
    start, end, counts = T.words(data, at, IS_SEPARATOR)
    return np.repeat(np.arange(len(counts)), counts), T.Spans(data).hash(start, end), counts


@dataclass
class Items:
    """A set of items: term numbers and their weights by item."""

    vocabulary: np.ndarray  # sorted hashes of the terms
    numbers: np.ndarray  # of the items
    terms: list[np.ndarray]  # places in the vocabulary, by item
    weights: list[np.ndarray]  # repeats times inverse document frequency, by item
    k: int
    lows: np.ndarray  # score that a document needs to matter, by item

    def askers(self) -> list[np.ndarray]:
        """For each term all terms of the items that ask for it."""
        item = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])
        term = np.concatenate([np.zeros(0, np.int64), *self.terms])
        order = np.argsort(term, kind="stable")
        cuts = np.searchsorted(term[order], np.arange(1, len(self.vocabulary)))
        return [np.unique(np.concatenate([self.terms[i] for i in part])) for part in np.split(item[order], cuts)]


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, repeats) of each item row's terms; ``item`` numbers the rows."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                row, term, _ = terms(data, at)
                yield pa.RecordBatch.from_arrays([part["item"].take(pa.array(row)), part["item_id"].take(pa.array(row)), pa.array(term.view(np.int64))], ["item", "item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return numbered.mapInArrow(cut, f"item long, item_id {kind}, term long").groupBy("item", "term").agg(F.first("item_id").alias("item_id"), F.count("*").alias("repeats"))


def counted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row: number of all terms, and those of the vocabulary with their occurrences, as int32 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                row, term, n = terms(data, at)
                place = np.minimum(np.searchsorted(known, term), len(known) - 1)
                found = known[place] == term
                key, tf = np.unique(row[found] * len(known) + place[found], return_counts=True)
                number = np.bincount(key // len(known), minlength=len(n))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), T.binaries((key % len(known)).astype(np.int32), number), T.binaries(tf.astype(np.int32), number)], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n long, terms binary, tfs binary")


def frequencies(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents by term) of a counted table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), np.int32), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for row in found.select("terms").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row.term] = row.df
    n, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return n, length, df


class Shard:
    """Some documents, their impacts by term, and the blocks of the lists that are asked for."""

    def __init__(self, ids: np.ndarray, absent: np.ndarray, impacts: np.ndarray, columns: list[np.ndarray], idf: np.ndarray):
        self.ids, self.absent, self.impacts, self.columns = ids, absent, impacts, columns
        self.most = impacts.max(0).astype(np.int64)
        signs = np.where(T.mix(np.arange(impacts.shape[1] * DIRECTIONS, dtype=np.uint64)) >> np.uint64(63), 1, -1).astype(np.float32)
        sketch = impacts.astype(np.float32) @ (signs.reshape(-1, DIRECTIONS) * idf[:, None].astype(np.float32))
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A list's documents ordered by block, each one's block, and the blocks' maxima in the term's ``columns``."""
        if term not in self.made:
            docs = np.flatnonzero(self.impacts[:, term])
            pivots = docs[:: BLOCK]
            near = np.zeros(len(docs), np.int64)
            for k in range(0, len(docs), 4096):
                near[k : k + 4096] = (self.sketch[docs[k : k + 4096]] @ self.sketch[pivots].T).argmax(1)
            order = np.argsort(near, kind="stable")
            docs, near = docs[order], near[order]
            first = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
            most = np.maximum.reduceat(self.impacts[np.ix_(docs, self.columns[term])], first, 0)
            self.made[term] = docs, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(docs)))), most
        return self.made[term]

    def search(self, wanted: np.ndarray, weights: np.ndarray, k: int, low: int, best: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """The best (scores, ids, absent) of those given and the shard's documents; low: least score that counts.

        The terms are left as soon as all of the rest together can't reach the k-th best score.
        """
        adds = weights * self.most[wanted]
        order = np.argsort(-adds, kind="stable")
        rest = np.cumsum(adds[order][::-1])[::-1]
        seen = np.zeros(len(self.ids), bool)
        for place, left in zip(order.tolist(), rest.tolist(), strict=True):
            if len(best[0]) == k:
                low = max(low, int(best[0][-1]))
            if left < low:
                break
            term = int(wanted[place])
            docs, block, most = self.blocks(term)
            bound = most[:, np.searchsorted(self.columns[term], wanted)] @ weights
            docs = docs[(bound >= low)[block]]
            docs = docs[~seen[docs]]
            if not len(docs):
                continue
            seen[docs] = True
            scores = self.impacts[np.ix_(docs, wanted)] @ weights
            good = scores >= low
            docs = docs[good]
            found = [np.concatenate(pair) for pair in zip(best, (scores[good], self.ids[docs], self.absent[docs]), strict=True)]
            top = np.lexsort((found[1], found[2], -found[0]))[:k]
            best = tuple(x[top] for x in found)
        return best


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches joined to tables of up to ``most`` rows."""
    held, rows = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            part = batch.slice(k, most)
            if rows + part.num_rows > most:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def searched(found: DataFrame, items: Items, idf: np.ndarray, n: int, length: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item."""
    shared = found.sparkSession.sparkContext.broadcast((items, idf))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf = shared.value
        columns, size = asked.askers(), len(asked.vocabulary)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in asked.numbers]
        for table in _shards(batches, max(16, CELLS // size)):
            term, tf = (np.frombuffer(b"".join(table[c].to_pylist()), np.int32).astype(np.int64) for c in ("terms", "tfs"))
            row = np.repeat(np.arange(len(table)), np.array([len(x) // 4 for x in table["terms"].to_pylist()], np.int64))
            norm = 75 + 25 * table["n"].to_numpy() * n // max(length, 1)
            impacts = np.zeros((len(table), size), np.int32)
            impacts[row, term] = 1_000_000_000 * tf // (1000 * tf + 12 * norm[row])
            ids = table["doc_id"].combine_chunks()
            shard = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), impacts, columns, idf)
            for i, low in enumerate(asked.lows.tolist()):
                best[i] = shard.search(asked.terms[i], asked.weights[i], asked.k, low, best[i])
        counts = [len(b[0]) for b in best]
        scores, ids, absent = (np.concatenate([np.zeros(0, kind), *[b[c] for b in best]]) for c, kind in enumerate((np.int64, np.int64, bool)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.numbers, counts)), pa.array(ids, mask=absent), pa.array(scores)], ["item", "doc_id", "score"])

    return found.select("doc_id", "n", "terms", "tfs").mapInArrow(search, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item.

    docs: doc_id, text; items: item_id, text.
    """
    scratch = Scratch(docs.sparkSession, "search")
    wanted = scratch.save(_item_terms(items), "item-terms")
    sets = -(-wanted.count() // item_terms)
    results = []
    for part in range(sets):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(sets)) == part).select("item", "term", "repeats").toPandas()
        if not len(rows):
            continue
        rows = rows.assign(term=rows["term"].to_numpy().view(np.uint64)).sort_values(["item", "term"])
        vocabulary = np.unique(rows["term"].to_numpy())
        found = scratch.save(counted(docs, vocabulary), "counted")
        n, length, df = frequencies(found, len(vocabulary))
        idf = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        numbers, cuts = np.unique(rows["item"].to_numpy(), return_index=True)
        places = np.split(np.searchsorted(vocabulary, rows["term"].to_numpy()), cuts[1:])
        weights = [r * idf[t] for r, t in zip(np.split(rows["repeats"].to_numpy(), cuts[1:]), places, strict=True)]
        asked = Items(vocabulary, numbers, places, weights, k, np.ones(len(numbers), np.int64))
        some = found.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SEED)) == 0)
        for row in _ranked(searched(some, asked, idf, n, length), k).where(F.col("rank") == k).select("item", "score").toLocalIterator():
            asked.lows[np.searchsorted(numbers, row.item)] = row.score
        counted_at = scratch.paths[-1]
        results.append(scratch.save(_ranked(searched(found, asked, idf, n, length), k), "ranked"))
        scratch.drop([counted_at])
    if not results:
        return wanted.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    ranked = results[0]
    for more in results[1:]:
        ranked = ranked.unionByName(more)
    names = wanted.select("item", "item_id").distinct()
    return scratch.finish(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
