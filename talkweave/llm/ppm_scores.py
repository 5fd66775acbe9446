"""Operator 5: language-model scores by prediction by partial matching over bytes.

Method (Cleary and Witten, 1984).  A text is the sequence of its words (lower-cased A-Z)
with one space between them and an end symbol after them, as bytes.  The model is a
trie of byte contexts: the context of a byte are the up to ORDER bytes before it, across
spaces, with end symbols before the text.  Counts are those of all occurrences in the
training texts.  A byte that the longest context has seen c of t times gets (2 c - 1) / 2 t
(method D); one that it hasn't seen costs an escape, d / 2 t for d distinct bytes seen, to
the next shorter context, from whose counts all bytes of the longer one are excluded; bytes
never seen share what is left.  So the probabilities of the next byte sum to one, and the
score of a text is the sum of the log10 probabilities of its bytes, the end included.

Jobs.  The probability of a byte depends on its gram (context and byte) only.  1. Texts are
read in blocks; a block sends each distinct gram and word hash once, with its training
count, packed by the range that the key's hash falls in.  2. Ranges add up equal keys.
3. Grams are worked out by the last two bytes of the context, as all shorter contexts
share these.  4. Ranges answer every block with the values of its keys.  5. A block's
answers meet its texts, and are added up by document.

Defined cases.  A null, empty or blank text has one token, the end.  Rows with a
null doc_id are scored, but neither learnt from nor held out.  Repeated rows are
learnt from and scored each.  Without training texts all bytes are equally likely.
Extra columns are ignored.  An empty table gives an empty result.  Words are told
apart by 63 bits of a hash.

Scale.  Nothing that grows with the corpus reaches the driver or a broadcast: only
the counts of byte pairs (65,536 at most) and totals do.  A range holds the keys of
about RANGE_BYTES of text whatever their frequency, as a block sends a key once; a
block is BLOCK_BYTES of text or one partition; long texts are worked on in slices.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T
from talkweave.llm.tables import Scratch

ORDER = 5
FOLDS = 10
ALPHA = 0.1
BLOCK_BYTES = 32 << 20
RANGE_BYTES = 16 << 20
#: Bytes of text whose grams are worked out at once.
SLICE = 1 << 19
#: Arrays of keys that are held before they are added up.
MERGED = 20
SPACE, END = 0x20, 0x0A
#: Keys of words have this bit, those of grams don't.
WORD = np.uint64(1 << 63)

PARTS = "block long, range int, keys binary, counts binary, text binary, ids binary, states binary"


def pack(values: np.ndarray) -> bytes:
    """Eight-byte numbers compressed, their bytes in planes."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, kind: type = np.uint64) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def stream(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows' words, lower-cased, each followed by a space, or by the end symbol where it is the row's last; a row without words is an end symbol."""
    start, end, counts = T.words(data, at)
    length = end - start
    blank = np.cumsum(counts == 0)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.cumsum(length + 1) - length - 1 + blank[row]
    out = np.full(int(length.sum()) + len(length) + int((counts == 0).sum()), SPACE, np.uint8)
    inside = ~T.IS_SPACE[data]
    out[np.repeat(place - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = T.LOWER[data[inside]]
    size = np.bincount(row, length + 1, len(counts)).astype(np.int64) + (counts == 0)
    out[np.cumsum(size) - 1] = END
    return out


def word_keys(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word of a stream, and its row."""
    start, end, _ = T.words(text, np.array([0, len(text)]))
    row = np.searchsorted(np.flatnonzero(text == END), start)
    return (T.Spans(text).hash(start, end) >> np.uint64(1)) | WORD, row


def gram_slices(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The gram of each byte of a stream, and its row, slice by slice."""
    first = np.concatenate([[0], np.flatnonzero(text == END) + 1])
    for low in range(0, len(text), SLICE):
        place = np.arange(low, min(low + SLICE, len(text)))
        row = np.searchsorted(first, place, "right") - 1
        inside = place - first[row]
        gram = text[place].astype(np.uint64)
        for k in range(1, ORDER + 1):
            before = np.where(inside >= k, text[np.maximum(place - k, 0)], END)
            gram |= before.astype(np.uint64) << np.uint64(8 * k)
        yield gram, row


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys added up, in order."""
    key, count = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(count, begin) if len(key) else count


class Lookup:
    """The places of keys in an array of distinct ones, by a hash table; all keys asked for are in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * T.BASES[0]) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        found = self.table[slot]
        wrong = np.flatnonzero(self.keys[found] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            found[wrong] = self.table[slot[wrong]]
            wrong = wrong[self.keys[found[wrong]] != keys[wrong]]
        return found


def _parts(docs: DataFrame, ranges: int) -> DataFrame:
    """By block: rows with its texts as streams, and rows with its distinct keys and their training counts by range."""
    names = [f.split()[0] for f in PARTS.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def row(**values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(n)], k) for n, k in zip(names, kinds, strict=True)], names)

    def sent(block: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, count = _summed(keys, counts)
        where = (T.mix(key) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            if len(part):
                yield row(block=block, range=int(where[part[0]]), keys=pack(key[part]), counts=pack(count[part]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        number = size = 0
        for batch in batches:
            for part, data, at in T.pieces(batch, "text", 2 * SLICE):
                block = (TaskContext.get().partitionId() << 24) + number
                text = stream(data, at)
                learnt = part["learnt"].to_numpy(zero_copy_only=False).astype(bool)
                for key, owner in [word_keys(text), *gram_slices(text)]:
                    mine = learnt[owner]
                    for of, unit in ((mine, 1), (~mine, 0)):
                        some, n = np.unique(key[of], return_counts=True)
                        keys.append(some)
                        counts.append(n * unit)
                if len(keys) > MERGED:
                    merged = _summed(keys, counts)
                    keys, counts = [merged[0]], [merged[1]]
                states = part["held_out"].to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * np.array(part["doc_id"].is_null()).astype(np.uint8)
                ids = np.array(part["doc_id"].fill_null(0)).astype(np.int64)
                yield row(block=block, text=len(text).to_bytes(8, "little") + pa.compress(text.tobytes(), "zstd", asbytes=True), ids=ids.tobytes(), states=states.tobytes())
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from sent(block, keys, counts)
                    keys, counts, number, size = [], [], number + 1, 0
        if keys:
            yield from sent((TaskContext.get().partitionId() << 24) + number, keys, counts)

    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    flags = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), F.coalesce(remainder != 0, F.lit(False)).alias("learnt"))
    return flags.mapInArrow(read, PARTS)


def _range_sums(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each of a range's rows; all its keys, and their training counts added up."""
    keys = [unpack(x) for x in table["keys"].to_pylist()]
    return keys, *_summed(keys, [unpack(x, np.int64) for x in table["counts"].to_pylist()])


def log_probabilities(gram: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after its context.

    gram, count: all grams whose contexts share their last two bytes (of one or more such
    pairs), each once, with their training counts; pairs: counts of (byte, next byte), 256 x 256.
    """
    none = pairs.sum(0)
    tables = {}  # by order: node keys, counts, context index of nodes, total and number of symbols by context
    for k in range(ORDER, 1, -1):
        key, inverse = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(inverse, count, len(key))
        context, of = np.unique(key >> 8, return_inverse=True)
        tables[k] = (key, n, of, np.bincount(of, n, len(context)), np.bincount(of, n > 0, len(context)), inverse)
    excluded = {}  # by order: of each node's context, what its symbols count one order lower
    for k in range(ORDER, 1, -1):
        key, n, of = tables[k][:3]
        low = tables[k - 1][1][np.searchsorted(tables[k - 1][0], key & ((1 << 8 * k) - 1))] if k > 2 else pairs[(key >> 8) & 255, key & 255]
        excluded[k] = np.bincount(of, low * (n > 0), len(tables[k][3]))
    symbol, byte = gram & 255, (gram >> 8) & 255
    excluded_1 = ((pairs > 0) * none).sum(1)
    result, found = np.zeros(len(gram)), np.zeros(len(gram), bool)
    above_d, above_x = np.zeros(len(gram)), np.zeros(len(gram))
    for k in range(ORDER, -1, -1):
        if k > 1:
            _, n, of, total, number, inverse = tables[k]
            context = of[inverse]
            c, t, d, x = n[inverse], total[context], number[context], excluded[k][context]
        elif k == 1:
            c, t, d, x = pairs[byte, symbol], pairs.sum(1)[byte], (pairs > 0).sum(1)[byte], excluded_1[byte]
        else:
            c, t, d, x = none[symbol], np.full(len(gram), none.sum()), np.full(len(gram), (none > 0).sum()), np.zeros(len(gram))
        new = d - above_d
        able = ~found & (new > 0)
        rest = np.maximum(t - above_x, 1)
        hit = able & (c > 0)
        result[hit] += np.log10((2 * c[hit] - 1) / (2 * rest[hit]))
        miss = able & (c == 0)
        result[miss] += np.log10(new[miss] / (2 * rest[miss]))
        found |= hit
        above_d, above_x = d, x
    result[~found] -= np.log10(np.maximum(256 - (none > 0).sum(), 1))
    return result


def scores(docs: DataFrame) -> DataFrame:
    """Every row's (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). docs: doc_id, text."""
    scratch = Scratch(docs.sparkSession, "ppm")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = scratch.save(_parts(docs, size // RANGE_BYTES + 1), "parts")
    sent, heads = parts.where("range IS NOT NULL").select("block", "range", "keys", "counts"), parts.where("range IS NULL")

    def add(table: pa.Table) -> pa.Table:
        _, key, count = _range_sums(table)
        word = key >= WORD
        gram = np.flatnonzero(~word)
        # one more row, without a gram, has the range's sums over words
        n = np.append(count[gram], count[word].sum())
        return pa.table({"range": np.full(len(n), table["range"][0].as_py(), np.int32), "gram": pa.array(np.append(key[gram], 0).astype(np.int64), mask=np.arange(len(n)) == len(gram)), "n": n, "known": np.append(np.zeros(len(gram), np.int64), (count[word] > 0).sum())})

    added = scratch.save(sent.groupBy("range").applyInArrow(add, "range int, gram long, n long, known long"), "grams")
    grams = added.where("gram IS NOT NULL").select("range", "gram", "n")
    total, distinct = added.where("gram IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    pairs = np.zeros((256, 256))
    for pair, n in grams.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n")).collect():
        pairs[pair >> 8, pair & 255] = n
    ends = int(pairs[:, END].sum())  # every training text has one end, and no word holds it
    total, distinct = total + ends, distinct + (ends > 0)

    def code(table: pa.Table) -> pa.Table:
        gram, n = table["gram"].to_numpy(), table["n"].to_numpy()
        return pa.table({"range": table["range"], "gram": gram, "code": log_probabilities(gram, n.astype(float), pairs)})

    suffix = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    codes = scratch.save(grams.groupBy(suffix.alias("suffix")).applyInArrow(code, "range int, gram long, code double"), "codes")

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        rows, key, count = _range_sums(asked)
        order = np.argsort(known["gram"].to_numpy())
        word = key >= WORD
        value = np.where(word, count, 0).astype(np.float64)
        value[~word] = known["code"].to_numpy()[order]
        return pa.table({"block": asked["block"], "keys": asked["keys"], "values": pa.array([pack(value[np.searchsorted(key, x)]) for x in rows], pa.binary())})

    answers = sent.groupBy("range").cogroup(codes.groupBy("range")).applyInArrow(answer, "block long, keys binary, values binary")
    none = F.lit(None).cast("binary")
    both = answers.select("*", none.alias("text"), none.alias("ids"), none.alias("states")).unionByName(heads.select("block", none.alias("keys"), none.alias("values"), "text", "ids", "states"))
    scale = total + ALPHA * (distinct + 1)

    def gather(table: pa.Table) -> pa.Table:
        told, texts = table.filter(table["text"].is_null()), table.filter(table["text"].is_valid())
        find = Lookup(np.concatenate([unpack(x) for x in told["keys"].to_pylist()]))
        value = np.concatenate([unpack(x, np.float64) for x in told["values"].to_pylist()])
        found = []
        for text, ids, states in zip(*(texts[c].to_pylist() for c in ("text", "ids", "states")), strict=True):
            text = np.frombuffer(pa.decompress(text[8:], int.from_bytes(text[:8], "little"), "zstd", asbytes=True), np.uint8)
            ids, states = np.frombuffer(ids, np.int64), np.frombuffer(states, np.uint8)
            per_row = functools.partial(np.bincount, minlength=len(ids))
            key, owner = word_keys(text)
            count = value[find(key)]
            score = np.zeros(len(ids))
            for gram, row in gram_slices(text):
                score += per_row(row, value[find(gram)])
            found.append(pa.table({
                "doc_id": pa.array(ids, mask=states >= 2), "held_out": states % 2 == 1, "n_tokens": per_row(owner).astype(np.int64) + 1,
                "n_known": per_row(owner, count > 0).astype(np.int64) + (ends > 0), "base_score": per_row(owner, np.log10((count + ALPHA) / scale)) + np.log10((ends + ALPHA) / scale), "score": score,
            }))
        return pa.concat_tables(found)

    out = both.groupBy("block").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scratch.finish(out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"))
