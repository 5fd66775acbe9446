"""Operator 13: spelling variants by search schemes on FM-indexes of the vocabulary.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of at
least LETTERS letters that occur at least OCCURRENCES times.  So that the corpus
has misspellings to find, one letter of some runs is deleted first, by a rule on
crc32 (see ``occurrences``).  Two words are near if one letter inserted, deleted or
replaced makes one the other.

Method.  One error leaves either half of a word as it is.  So a word is looked up
twice: its second half exactly and then leftwards over its first half with one
error, and its first half exactly and then rightwards.  Both are searches by
suffix-rank intervals in an FM-index over the delimited words (the second in that of
the words read backwards): a step takes an interval and a letter to the interval of
the longer match.  All queries of a batch step together.  In the half with the error, the letters
that continue an interval are listed once for all queries that share it.  A pair found by
both searches counts in the one of the first half only.

An index covers words with a half in common: words are dealt by the first and by the
last half, in the sizes that words one letter shorter or longer have too, and each
task indexes the groups of its partition as they come, CHUNK words at a time.
Groups of more than GROUP words are cut into parts, and every part asks every part in a
place of its own, so that no index or task grows with the corpus.

A word's form is its near word of largest n (ties: smallest in code-point order), if
its n is at least RATIO times the word's; its root is where the forms lead.

Defined cases.  Null and empty texts have no words; in rows whose doc_id is null no
letter is deleted.  Rows that repeat a doc_id or a text all count.  Words of any
length are kept whole.  Extra columns are ignored; an empty table gives an empty result.

Scale.  The texts are read once, and words are summed before the shuffle; all else
works on the vocabulary.  An n counts all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T
from talkweave.llm.tables import Scratch, small

LETTERS, OCCURRENCES, RATIO = 7, 2, 10
#: A letter of every so-many-th run is deleted, by crc32.
DELETED = 31
#: Words of an index, at least, and of a group with one half in common, at most.
CHUNK, GROUP = 1 << 16, 1 << 13
#: Words that are looked up at once.
BATCH = 1 << 14
#: Occurrences that are summed at once.
HELD = 1 << 21
#: Runs of more bytes are hashed one by one.
WIDE = 64
LEAD = 0xC3  # the first byte of U+00C0 to U+00FF
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), LEAD]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span, continuing the given crc32 of what comes before it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    begin, state = start[order], out[order]
    longest = int(size.max(initial=0))
    active = np.searchsorted(-size[order], -np.arange(min(longest, WIDE)), "left")
    for k, n in enumerate(active.tolist()):
        state[:n] = CRC[(state[:n] ^ data[begin[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > WIDE).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    return out


def occurrences(data: np.ndarray, at: np.ndarray, ids: list[int | None], letters: int = LETTERS) -> pa.Array:
    """All words of some texts, repeats included.

    Let h be crc32 of "<doc_id>:<lower-cased run>".  Where DELETED divides h, letter h modulo the run's length goes.
    """
    data = T.LOWER[data]
    inside = IS_LETTER[data]
    inside[1:] |= data[:-1] == LEAD
    start, end, counts = T.words(np.where(inside, data, np.uint8(0x20)), at)
    first = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(first)])
    size = before[end] - before[start]
    row = np.repeat(np.arange(len(counts)), counts)
    long = size >= letters
    start, end, size, row = start[long], end[long], size[long], row[long]
    given = np.array([i is not None for i in ids], bool)
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.int64)
    h = crc32(data, start, end, prefix[row]).astype(np.int64)
    hit = np.flatnonzero((h % DELETED == 0) & given[row])
    goes = np.flatnonzero(first)[before[start[hit]] + h[hit] % size[hit]]
    width = np.where(data[goes] == LEAD, 2, 1)
    bytes_of = end - start
    bytes_of[hit] -= width
    size[hit] -= 1
    kept = size >= letters
    edges = np.zeros(len(data) + 1, np.int8)
    edges[start[kept]] += 1
    edges[end[kept]] -= 1
    picked = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    picked[goes] = False
    picked[goes[width == 2] + 1] = False
    offsets = np.concatenate([[0], np.cumsum(bytes_of[kept])]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(int(kept.sum()), pa.py_buffer(offsets), pa.py_buffer(data[picked]))


def vocabulary(docs: DataFrame, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of all words that occur often enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.large_string()).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                held.append(occurrences(data, at, part["doc_id"].to_pylist(), letters))
                size += len(held[-1])
                if size >= HELD:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Index:
    """An FM-index over distinct words in ascending order, each with a delimiter (0) at both ends."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        number = len(at) - 1
        size = np.diff(at)
        text = np.zeros(len(data) + number + 1, np.uint8)
        text[np.arange(len(data)) + np.repeat(np.arange(1, number + 1), size)] = data
        order = self._suffixes(text, np.concatenate([[0], at[1:] + np.arange(1, number + 1)]))
        before = text[order - 1].astype(np.int64)
        self.letters = np.unique(text).astype(np.int64)
        self.code = np.full(256, -1, np.int64)
        self.code[self.letters] = np.arange(len(self.letters))
        self.last = self.code[before]
        self.last[0] = -1  # nothing stands before the first delimiter
        self.first = np.searchsorted(np.sort(text), self.letters)
        self.blocks = len(text) // 64 + 1
        place = np.flatnonzero(self.last >= 0)
        cell = self.last[place] * self.blocks + (place >> 6)
        by = np.argsort(cell, kind="stable")
        cell, bit = cell[by], np.uint64(1) << (place[by] & 63).astype(np.uint64)
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.bits = np.zeros(len(self.letters) * self.blocks, np.uint64)
        self.bits[cell[starts]] = np.add.reduceat(bit, starts)
        counts = np.bitwise_count(self.bits).astype(np.int64).reshape(len(self.letters), -1)
        self.counts = (np.cumsum(counts, 1) - counts).ravel()

    @staticmethod
    def _suffixes(text: np.ndarray, delimiters: np.ndarray) -> np.ndarray:
        """Places in order of what follows up to the next delimiter, then of place; by doubling, from eight letters on."""
        place = np.arange(len(text))
        left = delimiters[np.searchsorted(delimiters, place)] - place
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        key = np.zeros(len(text), np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | np.where(k < left, padded[k : k + len(text)], 0).astype(np.uint64)
        rank = np.unique(key, return_inverse=True)[1]
        width = 8
        while width <= left.max(initial=0):
            further = np.where(left >= width, rank[np.minimum(place + width, len(text) - 1)] + 1, 0)
            rank = np.unique(rank * (len(text) + 1) + further, return_inverse=True)[1]
            width *= 2
        return np.argsort(rank, kind="stable")

    def occurring(self, letter: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many of the first ``end`` suffixes come after the letter (by code)."""
        cell = letter * self.blocks + (end >> 6)
        below = (np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[cell] + np.bitwise_count(self.bits[cell] & below)

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with the letter (by code; -1: in no word) before them."""
        known = np.maximum(letter, 0)
        low, high = (self.first[known] + self.occurring(known, x) for x in (low, high))
        return low, np.where(letter < 0, low, high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letters that continue distinct intervals: (interval's number, letter, low, high), in order of number."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        letter = self.last[row]
        owner, letter = owner[letter > 0], letter[letter > 0]  # neither a delimiter nor nothing
        key, count = np.unique(owner * 256 + letter, return_counts=True)
        owner, letter = key >> 8, key & 255
        below = self.first[letter] + self.occurring(letter, low[owner])
        return owner, letter, below, below + count

    def near(self, data: np.ndarray, at: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs with one error before the last ``exact`` letters of the query."""
        size, end = np.diff(at), at[1:]
        code = self.code[data]
        alive = np.arange(len(size))
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.first[1] if len(self.letters) > 1 else 0)
        found: list[tuple[np.ndarray, ...]] = []  # query, letters read, interval; the error is behind them
        for read in range(int(size.max(initial=0)) + 1):
            open_ = alive[(exact[alive] <= read)]
            if len(open_):
                found += self._errors(open_, read, code, size, end, low, high)
            alive = alive[size[alive] > read]
            low[alive], high[alive] = self.step(code[end[alive] - 1 - read], low[alive], high[alive])
            alive = alive[low[alive] < high[alive]]
        query, read, low, high = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(4))
        pairs = []
        while len(query):
            done = read == size[query]
            begin, stop = (self.occurring(np.zeros(int(done.sum()), np.int64), x[done]) for x in (low, high))
            pairs.append((query[done][begin < stop], begin[begin < stop]))
            query, read, low, high = (x[~done] for x in (query, read, low, high))
            low, high = self.step(code[end[query] - 1 - read], low, high)
            some = low < high
            query, read, low, high = query[some], read[some] + 1, low[some], high[some]
        return tuple(np.concatenate([np.zeros(0, np.int64), *[p[k] for p in pairs]]) for k in range(2))

    def _errors(self, query: np.ndarray, read: int, code: np.ndarray, size: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """What one error after ``read`` letters makes of the queries' intervals, each result once: in a run of equal letters the last one is deleted, and a letter is inserted after its like."""
        node, of = np.unique(low[query] * (len(self.last) + 1) + high[query], return_inverse=True)
        owner, letter, below, above = self.children(node // (len(self.last) + 1), node % (len(self.last) + 1))
        begin = np.searchsorted(owner, np.arange(len(node) + 1))
        number = np.diff(begin)[of]
        child = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(begin[of], number)
        asker = np.repeat(query, number)
        inner = size[query] > read
        next_ = np.full(len(query), -2)
        next_[inner] = code[end[query[inner]] - 1 - read]
        other = letter[child] != np.repeat(next_, number)
        asker, child = asker[other], child[other]
        constant = lambda n, value: np.full(n, value)
        inserted = asker, constant(len(asker), read), below[child], above[child]
        more = size[asker] > read
        replaced = asker[more], constant(int(more.sum()), read + 1), below[child[more]], above[child[more]]
        query, next_ = query[inner], next_[inner]
        run = np.zeros(len(query), bool)
        far = np.flatnonzero(size[query] > read + 1)
        run[far] = code[end[query[far]] - 2 - read] == next_[far]
        query = query[~run]
        return [inserted, replaced, (query, constant(len(query), read + 1), low[query], high[query])]


def _reversed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Every word's letters backwards."""
    return data[np.repeat(at[:-1] + at[1:] - 1, np.diff(at)) - np.arange(len(data))]


def _found(words: pa.Array, n: np.ndarray, asking: pa.Array, first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of near pairs whose first half is equal, or of those whose second half is and whose first half isn't; words: in ascending order."""
    data, at = T.buffers(words)
    asked, asked_at = T.buffers(asking)
    size = np.diff(asked_at)
    order = np.arange(len(words))
    if first_half:
        turned = _reversed(data, at)
        order = pc.sort_indices(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(turned)])).to_numpy().astype(np.int64)
        lengths = np.diff(at)[order]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        index = Index(turned[np.arange(len(data)) + np.repeat(at[order] - ends[:-1], lengths)], ends)
    else:
        index = Index(data, at)
    pairs = []
    for k in range(0, len(size), BATCH):
        ends = asked_at[k : k + BATCH + 1]
        part, ends = asked[ends[0] : ends[-1]], ends - ends[0]
        half = np.diff(ends) // 2
        query, word = index.near(_reversed(part, ends) if first_half else part, ends, half if first_half else np.diff(ends) - half)
        if not first_half:
            equal = np.ones(len(query), bool)
            for j in range(int(half.max(initial=0))):
                still = np.flatnonzero(equal & (half[query] > j))
                equal[still] = part[ends[query[still]] + j] == data[at[word[still]] + j]
            query, word = query[~equal], word[~equal]
        pairs.append((query + k, order[word]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *[p[i] for p in pairs]]) for i in range(2))


def _neighbours(table: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the asking words of some whole groups of one side."""
    first_half = table["key"][0].as_py().startswith(b"p")
    kept = table.filter(table["indexed"]).select(["word", "n"]).group_by("word").aggregate([("n", "max")]).sort_by("word")
    words, n = kept["word"].combine_chunks(), kept["n_max"].to_numpy()
    asking = pc.unique(table.filter(table["asks"])["word"])
    query, word = _found(words, n, asking, first_half)
    order = np.lexsort((word, -n[word], query))
    query, word = query[order], word[order]
    best = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else query
    number = np.diff(np.append(best, len(query)))
    return pa.RecordBatch.from_arrays([asking.take(pa.array(query[best])), pa.array(number), pa.array(n[word[best]]), words.take(pa.array(word[best]))], ["word", "n_near", "best_n", "best"])


def _dealt(words: DataFrame, scratch: Scratch, letters: int, group: int) -> DataFrame:
    """(key, parts, cell, word, n, indexed, asks): every word in the groups of its halves, in all lengths that matter.

    A group of ``parts`` parts has parts ** 2 cells: in cell i * parts + j the words of part j ask the index of part i.
    """
    size = F.length("word")

    def halves(side: str, half: Callable[[Column], Column]) -> Column:
        lengths = F.array_distinct(F.array(*[half(x).cast("int") for x in (F.greatest(size - 1, F.lit(letters)), size, size + 1)]))
        return F.transform(lengths, lambda k: F.struct(F.lit(side).alias("side"), k.alias("k"), (k == half(size)).alias("asks")))

    sizes = F.concat(halves("p", lambda x: F.floor(x / 2)), halves("s", lambda x: F.ceil(x / 2)))
    rows = words.select("word", "n", F.explode(sizes).alias("x")).withColumn("word", F.encode("word", "ISO-8859-1"))
    cut = F.when(F.col("x.side") == "p", F.substring("word", F.lit(1), F.col("x.k"))).otherwise(F.substring("word", F.octet_length("word") - F.col("x.k") + 1, F.col("x.k")))
    rows = rows.select(F.concat(F.encode("x.side", "ISO-8859-1"), cut).alias("key"), "word", "n", "x.asks")
    large = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > group)
    large = scratch.save(large.select("key", F.ceil(F.col("rows") / group).cast("long").alias("parts")), "large")
    rows = rows.join(small(large, F.octet_length("key")), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")))
    parts, own = F.col("parts"), F.col("own")
    all_parts = F.sequence(F.lit(0).cast("long"), parts - 1)
    cells = F.concat(F.transform(all_parts, lambda j: own * parts + j), F.when(F.col("asks"), F.transform(all_parts, lambda i: i * parts + own)).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn("cell", F.explode(F.array_distinct(cells)))
    return rows.select("key", "parts", "cell", "word", "n", (F.floor(F.col("cell") / parts) == own).alias("indexed"), (F.col("asks") & (F.col("cell") % parts == own)).alias("asks"))


def _chunks(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
    """Whole groups, as many as make a chunk, each side and each cell of a large group for itself; and what is left, if more may follow."""
    key, cell = table["key"].combine_chunks(), table["cell"].to_numpy()
    new = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(np.append(True, new))
    side = pc.binary_slice(key, 0, 1).take(pa.array(at)).to_pylist()
    alone = table["parts"].to_numpy()[at] > 1
    begin, found = 0, []
    for i in range(1, len(at)):
        if alone[i] or alone[begin] or side[i] != side[begin] or at[i] - at[begin] >= CHUNK:
            found.append(table.slice(at[begin], at[i] - at[begin]))
            begin = i
    rest = table.slice(at[begin])
    return ([*found, rest], rest.slice(0, 0)) if last else (found, rest)


def _searched(dealt: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): of each word and group, the near words found there and the best of them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            if held.num_rows > CHUNK:
                found, held = _chunks(held, False)
                yield from map(_neighbours, found)
        if held is not None and held.num_rows:
            yield from map(_neighbours, _chunks(held, True)[0])

    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(search, "word binary, n_near long, best_n long, best binary")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every word with a form: where forms lead, by pointer doubling; forms: word, form."""
    links = scratch.save(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(small(further, F.octet_length("root") + F.octet_length("next")), "root", "left")
        before = scratch.paths[-1]
        links = scratch.save(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        scratch.drop([before])
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def spelling_variants(docs: DataFrame, letters: int = LETTERS, least: int = OCCURRENCES, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the documents.

    docs: doc_id, text.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs, letters, least), "words")
    found = _searched(_dealt(words, scratch, letters, group)).select(*[F.decode(c, "ISO-8859-1").alias(c) if c in ("word", "best") else F.col(c) for c in ("word", "n_near", "best_n", "best")])
    none = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    both = words.select("word", "n", *none).unionByName(found.withColumn("n", F.lit(None).cast("long")))
    rank = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))
    summed = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(rank).alias("best"))
    counts = -F.col("best.less") >= ratio * F.col("n")
    formed = scratch.save(summed.select("word", "n", "n_near", F.when(counts, F.col("best.best")).alias("form"), F.when(counts, -F.col("best.less")).alias("form_n")), "formed")
    led = roots(formed.where("form IS NOT NULL"), scratch)
    return scratch.finish(formed.join(small(led, F.octet_length("word") + F.octet_length("root")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
