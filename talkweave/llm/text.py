"""Vectorised byte-level text work on Arrow batches: words, hashes, distinct sets.

Everything here handles a few megabytes of text at a time; ``pieces`` cuts an
Arrow batch so that temporary arrays stay small whatever the batch holds.  A row
is never cut: one very long text makes one larger piece.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 17

#: Word separators U+0020 and U+0009-U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    out = h >> np.uint64(30)
    out ^= h
    out *= np.uint64(0xBF58476D1CE4E5B9)
    shifted = out >> np.uint64(27)
    out ^= shifted
    out *= np.uint64(0x94D049BB133111EB)
    shifted = np.right_shift(out, np.uint64(31), out=shifted) if out.ndim else out >> np.uint64(31)
    out ^= shifted
    return out


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in range(size)."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        np.cumprod(p, out=p)
        out.append(p)
    return out[0], out[1]


def powers(base: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As long as needed, rounded up so that few sizes are cached."""
    return _powers(int(base), 1 << max(20, int(size).bit_length()))


#: Values of a span that the running sum hashes.
SHORT = 32


class Spans:
    """Hashes of any spans of one sequence: of up to SHORT values from one running sum, of more by xxhash.

    The sum is a polynomial modulo 2**64.  For such there are long sequences (from 2**10
    values) that collide for every base, as their difference is a product of many even
    factors; that of two short ones has fewer than 20 factors of two from there, of 64.
    """

    def __init__(self, values: np.ndarray, base: np.uint64 = BASES[0]):
        self.values = values
        p, self.inverse = powers(base, len(values) + 1)
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0], rest = 0, self.sums[1:]
        np.add(values, np.uint64(1), out=rest)
        rest *= p[: len(values)]
        np.cumsum(rest, out=rest)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = mix(self.sum(start, end))
        long = np.flatnonzero(end - start > SHORT)
        if len(long):
            raw, width = self.values.tobytes(), self.values.itemsize
            h[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((start[long] * width).tolist(), (end[long] * width).tolist(), strict=True)]
        return h

    def sum(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of short spans before it is mixed."""
        h = self.sums[end]
        h -= self.sums[start]
        h *= self.inverse[start]
        length = (end - start).astype(np.uint64)
        length *= LENGTH
        h += length
        return h

    def steps(self, edges: np.ndarray, width: int) -> np.ndarray:
        """The sums of the (short) spans from each of ascending edges to the one ``width`` further on."""
        at, start = self.sums[edges], edges[:-width]
        h = at[width:] - at[:-width]
        h *= self.inverse[start]
        length = (edges[width:] - start).view(np.uint64)
        length *= LENGTH
        h += length
        return h


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and each row's start in them (one more: the end)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@functools.lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives free memory back; one that does nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give free memory back to the system: a worker lives on after its task, beside the executor's and those of later stages."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with about ``most`` bytes of text: (slice, bytes, row starts)."""
    texts = strings(batch.column(column))
    if not len(texts):
        return
    _, at = buffers(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin), *buffers(texts.slice(begin, end - begin))
        begin = end
    release()


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined to blocks of about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part, data, _ in pieces(batch, column):
            held.append(part)
            size += len(data)
            if size >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    held.clear()
    release()


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of non-separators inside rows: starts, ends, and the number of each row's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, at))


def shingles(word_hash: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each row and their number by row; a row of 1 to k-1 words gives one hash of them all."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), number)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + first[row]
    spans = Spans(word_hash, BASES[1])
    return spans.hash(begin, begin + np.minimum(k, counts[row])), number


#: Bits of a hash that ``distinct`` keeps; the other bits number the rows sorted together.
HASH_BITS = 58


def distinct(hashes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes, cut to their upper HASH_BITS bits, sorted and without repeats, and their new number by row."""
    low, rows = np.uint64(64 - HASH_BITS), 1 << (64 - HASH_BITS)
    at = np.concatenate([[0], np.cumsum(number)])
    found, counts = [np.zeros(0, np.uint64)], []
    for k in range(0, len(number), rows):
        part = number[k : k + rows]
        key = np.repeat(np.arange(len(part), dtype=np.uint64) << np.uint64(HASH_BITS), part) | (hashes[at[k] : at[k + len(part)]] >> low)
        key.sort()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        found.append(key << low)
        counts.append(np.bincount((key >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(part)))
    return np.concatenate(found), np.concatenate([np.zeros(0, np.int64), *counts])


def true_bits(table: np.ndarray) -> np.ndarray:
    """The number of true values in each line of a table."""
    return np.bitwise_count(np.packbits(table, axis=1)).sum(1, dtype=np.int64)


def binaries(values: np.ndarray, number: np.ndarray) -> pa.Array:
    """A binary array whose rows are the raw bytes of consecutive runs of ``values``."""
    at = np.concatenate([[0], np.cumsum(number * values.dtype.itemsize)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(number), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
