"""Operator 9: token counts by compiled finite-state transducers.

Method.  Two deterministic transducers run over a text.

* The word rule (``pretokens``): nine states, whose chunk maps are composed by a
  parallel prefix scan, cuts the text into pieces.
* The merge rule: reads a piece byte by byte; each transition is annotated with
  the number of tokens by which the encoding of what was read so far grows.

A state of the second one is a node of the trie of token prefixes (the longest
suffix of what was read that begins a longer token) together with, for each cut in
that suffix from which a token may still run on, the last token of the encoding up
to the cut and its number of tokens relative to now.  The encoding of a longer prefix ends in the one token,
among those that end here, that may stand after the last token at its own begin:
two tokens may be neighbours if no merge across their border would have been
applied before the merges that made them.  So the next state and the growth
follow from state and byte alone.  States are compiled when first reached and
kept in tables, which are dropped and begun anew beyond MOST_STATES.

Pieces are cut into chunks of CHUNK bytes, and all distinct chunks of a block run at
once, one byte per step.  A chunk's map tells, for each state in which it may begin,
the state in which it ends and the tokens it adds.  A piece begins in the first state;
a later chunk may begin there (a guess, so that no chunk waits for another) or where
the maps of the chunk before end.  Encodings soon fall into step whatever stood
before, so nearly all maps have two entries; entries are added until no map ends in
a state that the next one lacks.  The maps of a piece are then composed by a parallel
prefix scan (pointer doubling), which gives its count whatever its length.

Defined cases.  A null or empty text has no bytes and no tokens.  The special
token's string inside a text counts as one token.  Repeated rows give repeated
rows; extra columns are ignored.  Very long texts are counted whole.

Scale.  No shuffle; a task holds one piece of text and its tables; the vocabulary
file, of fixed size, is broadcast.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T
from talkweave.llm.pretokens import pretokens
from talkweave.llm.vocabulary import Vocabulary, parse

LIMIT_TOKENS = 1024
MOST_STATES = 400_000
#: Bytes of a chunk, the part of a piece that has a map of its own.
CHUNK = 96
BLOCK_BYTES = 4 << 20


class Transducer:
    """The merge rule of a vocabulary, compiled as far as it has been used."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.made = np.full(len(v.token_bytes), -1, np.int64)  # rank of the merge that makes a token; -1: a byte
        order = np.arange(len(v.merged))[::-1]
        self.made[v.merged[order]] = order  # the first merge that makes it counts
        self.halves = {int(v.merged[r]): (int(v.left[r]), int(v.right[r])) for r in order}
        self.rank = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(v.left, v.right, strict=True))}
        self.made = self.made.tolist()
        self.byte_id = v.byte_id.tolist()
        self.special = v.special
        tokens = {v.token_bytes[i]: i for i in {*self.byte_id, *self.halves}}
        self.node: dict[bytes, int] = {}  # of every proper prefix of a token
        for token in tokens:
            for k in range(len(token)):
                self.node.setdefault(token[:k], len(self.node))
        self.string = list(self.node)
        self.tokens = tokens
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.used = 0
        self.grow(1 << 16)
        self.state(self.node[b""], [(-1, 0)])

    def grow(self, size: int) -> None:
        """An open-addressing table of ``size`` transitions: state and byte, next state, growth."""
        old = getattr(self, "slots", None) if self.used else None
        filled = np.flatnonzero(old >= 0) if old is not None else np.zeros(0, np.int64)
        kept = [x[filled] for x in (self.slots, self.next, self.grows)] if len(filled) else [[], [], []]
        self.slots, self.next, self.grows = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int8)
        self.used = 0
        for key, then, more in zip(*kept, strict=True):
            self.put(int(key), then, more)

    def put(self, key: int, then: int, more: int) -> None:
        if 2 * self.used >= len(self.slots):
            self.grow(2 * len(self.slots))
        place = self.home(key)
        while self.slots[place] >= 0:
            place = (place + 1) & (len(self.slots) - 1)
        self.slots[place], self.next[place], self.grows[place] = key, then, more
        self.used += 1

    def home(self, key):  # noqa: ANN001, ANN201
        """Where the search for a key (or an array of keys) begins."""
        return ((key * 0x9E3779B1) >> 15) & (len(self.slots) - 1)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key in the table; -1 where it isn't there."""
        place = self.home(key)
        out = np.where(self.slots[place] == key, place, -1)
        open_ = np.flatnonzero((out < 0) & (self.slots[place] >= 0))
        while len(open_):
            p = place[open_] = (place[open_] + 1) & (len(self.slots) - 1)
            hit = self.slots[p] == key[open_]
            out[open_[hit]] = p[hit]
            open_ = open_[~hit & (self.slots[p] >= 0)]
        return out

    def state(self, node: int, cuts: list[tuple[int, int] | None]) -> int:
        """The number of a state; cuts: last token and relative count by cut, None where no token can run on."""
        key = struct.pack(f"i{len(cuts)}q", node, *((c[0] << 16) + c[1] if c else -1 << 40 for c in cuts))
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def may_follow(self, a: int, b: int) -> bool:
        """May b stand right after a in an encoding?"""
        known = self.neighbours.get((a, b))
        if known is None:
            known = self.neighbours[a, b] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        # Merges inside a and b were applied in order of rank.  Undo the latest of those that touch the border;
        # a merge across it with a lower rank (on a tie, further left) would have come first.
        while True:
            across = self.rank.get((a, b))
            ra, rb = self.made[a], self.made[b]
            if ra < 0 and rb < 0:
                return across is None or self._limit(across)
            if across is not None and not self._limit(across):
                return False
            if ra > rb:  # on a tie the left one came first
                self.bound, self.wins_tie = ra, True
                a = self.halves[a][1]
            else:
                self.bound, self.wins_tie = rb, False
                b = self.halves[b][0]

    bound, wins_tie = 1 << 60, True

    def _limit(self, across: int) -> bool:
        """Is the merge across the border too late to be applied?"""
        return across > self.bound or across == self.bound and self.wins_tie

    def compile(self, state: int, byte: int) -> None:
        """Fill in one transition."""
        node, *packed = struct.unpack(f"i{len(self.keys[state]) // 8 - 1}q", self.keys[state])
        read = self.string[node] + bytes([byte])
        last = count = None
        for k in range(len(read)):
            token = self.tokens.get(read[k:])
            if token is None:
                continue
            before = packed[k] + (1 << 15) >> 16
            number = packed[k] - (before << 16)
            self.bound, self.wins_tie = 1 << 60, True
            if before < 0 or self.may_follow(before, token):
                last, count = token, number + 1
                break
        skip = 0
        while read[skip:] not in self.node:
            skip += 1
        read, packed = read[skip:], packed[skip:]
        cuts = [((x + (1 << 15)) >> 16, x - (((x + (1 << 15)) >> 16) << 16) - count) if read[k:] in self.node else None for k, x in enumerate(packed)]
        self.put(state * 256 + byte, self.state(self.node[read], [*cuts, (last, 0)]), count)

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Number of tokens of each of consecutive pieces."""
        if len(self.keys) > MOST_STATES:
            self.clear()
        length = np.diff(starts)
        number = -(-length // CHUNK)  # chunks of each piece
        first = np.cumsum(number) - number
        piece = np.repeat(np.arange(len(length)), number)
        begin = starts[:-1][piece] + CHUNK * (np.arange(len(piece)) - first[piece])
        size = np.minimum(CHUNK, starts[1:][piece] - begin)
        out = np.zeros(len(length), np.int64)
        whole, several = number[piece] == 1, np.flatnonzero(number > 1)
        out[piece[whole]] = self.run(data, begin[whole], size[whole], np.zeros(whole.sum(), np.int64))[1]
        if len(several):
            heads = np.cumsum(number[several]) - number[several]
            out[several] = self._composed(data, begin[~whole], size[~whole], heads)
        return out

    def run(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks of at most CHUNK bytes end that begin in the given states, and the tokens they add."""
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(CHUNK + 1), "left")  # alive[k]: chunks with more than k bytes
        begin, at, total = begin[order], state[order], np.zeros(len(order), np.int64)
        for k in range(CHUNK):
            m = int(alive[k])
            if not m:
                break
            key = at[:m] * 256 + data[begin[:m] + k]
            place = self.find(key)
            if (place < 0).any():
                for missing in np.unique(key[place < 0]).tolist():
                    self.compile(missing >> 8, missing & 255)
                place = self.find(key)
            total[:m] += self.grows[place]
            at[:m] = self.next[place]
        end, added = np.empty_like(at), np.empty_like(total)
        end[order], added[order] = at, total
        return end, added

    def _composed(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Number of tokens of each piece of several chunks; heads: the pieces' first chunks, ascending."""
        texts = [data[a : a + n].tobytes() for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
        content = pa.array(texts, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        sample = np.unique(content, return_index=True)[1]  # a chunk of each content
        last = np.zeros(len(begin), bool)
        last[np.append(heads[1:], len(begin)) - 1] = True
        # an entry of a map: its chunk and state as one number, where it ends, what it adds
        entries, ends, adds = (np.zeros(0, np.int64) for _ in range(3))
        new = np.arange(len(begin)) << 32
        while len(new):
            chunk = new >> 32
            runs, which = np.unique(content[chunk] << 32 | new & 0xFFFFFFFF, return_inverse=True)
            one = sample[runs >> 32]
            end, added = (x[which] for x in self.run(data, begin[one], size[one], runs & 0xFFFFFFFF))
            entries, ends, adds = (np.concatenate(x) for x in ((entries, new), (ends, end), (adds, added)))
            new = np.setdiff1d((chunk + 1 << 32 | end)[~last[chunk]], entries)
        order = np.argsort(entries)
        entries, ends, adds = entries[order], ends[order], np.append(adds[order], 0)
        chunk = entries >> 32
        then = np.append(np.where(last[chunk], len(entries), np.searchsorted(entries, chunk + 1 << 32 | ends)), len(entries))
        for _ in range(int(np.diff(np.append(heads, len(begin))).max()).bit_length()):
            adds, then = adds + adds[then], then[then]
        return adds[np.searchsorted(entries, heads << 32)]


@functools.lru_cache(maxsize=1)
def transducer(content: bytes) -> Transducer:
    return Transducer(parse(content))


def count_rows(texts: pa.Array, machine: Transducer) -> np.ndarray:
    """Number of tokens of each row of a string array."""
    data, at = T.buffers(texts)
    special = next(iter(machine.special), b"")
    begin, number = pretokens(data, at, special)
    if not len(data):
        return np.zeros(len(texts), np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(data)]).dictionary_encode()
    raw, starts = T.buffers(coded.dictionary)
    counts = machine.counts(raw, starts)
    for k in np.flatnonzero(np.diff(starts) == len(special)) if special else ():
        if raw[starts[k] : starts[k + 1]].tobytes() == special:
            counts[k] = 1
    total = np.concatenate([[0], np.cumsum(counts[coded.indices.to_numpy(zero_copy_only=False)])])
    ends = np.concatenate([[0], np.cumsum(number)])
    return total[ends[1:]] - total[ends[:-1]]


def token_counts(docs: DataFrame, content: bytes, limit: int = LIMIT_TOKENS) -> DataFrame:
    """Every row's (doc_id, n_bytes, n_tokens, over_limit); content: the bytes of the vocabulary file."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            for part, data, at in T.pieces(batch, "text", BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(at)), pa.array(count_rows(T.strings(part["text"]), machine))], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
