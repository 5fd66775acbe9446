"""Operator 7: byte-level BPE encoding and decoding by a pair occurrence index.

Method.  The distinct pieces of a block of texts are laid out as one linked list
of byte tokens.  An index maps each adjacent pair that has a merge rank to all
its positions in the block.  Ranks that are active are taken in ascending order
from a heap; all positions of a rank are merged at once (in runs of one token the
leftmost first), and the pairs that arise at both sides are entered in the index.
Entries that a merge has made stale are recognised when their rank comes up.
Token ids of texts are gathered from their pieces; decoding joins token bytes.

Defined cases.  A null or empty text has no tokens and decodes to the empty text.
The special token's string inside a text is that one token.  Repeated rows give
repeated rows; other columns are carried or ignored.  Very long texts and pieces
are encoded whole.  Ids outside the vocabulary raise an error in decoding.

Scale.  No shuffle; blocks of BLOCK_BYTES bound the memory of a task, and the
vocabulary, of fixed size, is broadcast as the bytes of its file.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from talkweave.llm import text as T
from talkweave.llm.pretokens import pretokens
from talkweave.llm.vocabulary import Vocabulary, parse

#: Text of one block, whose distinct pieces share one index.
BLOCK_BYTES = 3 << 20
#: Positions whose pairs are looked up at once when the index is begun.
POSITIONS = 1 << 17
#: Text whose pieces are cut at once.
CUT_BYTES = 1 << 18


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted positions whose pair overlaps the next one's (runs of one token), every other, from the left."""
    starts = np.ones(len(at), bool)
    starts[1:] = after[at[:-1]] != at[1:]
    index = np.arange(len(at))
    return at[(index - np.maximum.accumulate(np.where(starts, index, 0))) % 2 == 0]


def encode_pieces(data: np.ndarray, begin: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of consecutive pieces (begin: their byte offsets and the end) and the number of each piece's tokens."""
    n = len(data)
    token = np.full(n + 1, -1, np.int64)
    token[:n] = vocabulary.byte_id[data]
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[begin[1:] - 1] = n
    before[begin[:-1]] = n
    after[n] = before[n] = n
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = vocabulary.ranks(token[at], token[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, positions in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(positions)

    for k in range(0, n, POSITIONS):
        enter(np.arange(k, min(k + POSITIONS, n)))
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        a, b = vocabulary.left[r], vocabulary.right[r]
        at = at[(token[at] == a) & (token[after[at]] == b)]
        if a == b and len(at) > 1:
            at = _leftmost(at, after)
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        token[at], token[gone] = vocabulary.merged[r], -1
        after[at] = beyond
        before[beyond] = at
        before[n] = n
        left = before[at]
        enter(np.unique(np.concatenate([left[left < n], at])))
    alive = np.flatnonzero(token[:n] >= 0)
    return token[alive], np.diff(np.searchsorted(alive, begin))


def _cut(data: np.ndarray, at: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``pretokens``, some rows at a time, as rows don't depend on each other; a row is never cut."""
    begins, numbers, k = [], [], 0
    while k < len(at) - 1:
        end = max(k + 1, int(np.searchsorted(at, at[k] + CUT_BYTES, "right")) - 1)
        begin, number = pretokens(data[at[k] : at[end]], at[k : end + 1] - at[k], special)
        begins.append(begin[:-1] + at[k])
        numbers.append(number)
        k = end
    return np.concatenate([*begins, at[-1:]]), np.concatenate(numbers)


def encode_rows(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the rows of a string array, one after the other, and the number of each row's tokens."""
    data, at = T.buffers(texts)
    special = next(iter(vocabulary.special), b"")
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    begin, number = _cut(data, at, special)
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(data)])
    coded = every.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    raw, starts = T.buffers(coded.dictionary)
    ids, length = encode_pieces(raw, starts, vocabulary)
    first = np.cumsum(length) - length
    if special:
        for k in np.flatnonzero(np.diff(starts) == len(special)):
            if raw[starts[k] : starts[k + 1]].tobytes() == special:
                ids = np.append(ids, vocabulary.special[special])
                first[k], length[k] = len(ids) - 1, 1
    del every, coded, raw
    each = length[which]
    place = np.repeat(first[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(number)])]
    return ids[place], np.diff(ends)


def _shared(frame: DataFrame, content: bytes):
    return frame.sparkSession.sparkContext.broadcast(content)


def encode(frame: DataFrame, content: bytes, column: str = "text", ids: str = "ids", verified: str | None = None) -> DataFrame:
    """The frame with a column of token ids (array<int>) of its text column; content: the vocabulary file's bytes.

    verified: a further column that says whether decoding the ids gives the text back (null: the empty text).
    """
    shared = _shared(frame, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = parse(shared.value)
        for block in T.blocks(batches, column, BLOCK_BYTES):
            tokens, number = encode_rows(T.strings(block[column]), vocabulary)
            ends = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
            columns = dict(zip(block.schema.names, block.columns, strict=True)) | {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.astype(np.int32)))}
            if verified:
                texts = T.strings(block[column])
                columns[verified] = pa.array([decode_ids(tokens[ends[k] : ends[k + 1]], vocabulary) == texts[k].as_buffer().to_pybytes() for k in range(len(texts))], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    kept = frame.drop(ids, *filter(None, [verified]))
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(ids, ArrayType(IntegerType())), *[StructField(v, BooleanType()) for v in filter(None, [verified])]]))


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The bytes of a token sequence, special tokens included."""
    return b"".join(map(vocabulary.token_bytes.__getitem__, ids.tolist()))


def decode(frame: DataFrame, content: bytes, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """The frame with the text of its token ids; bytes that aren't UTF-8 become U+FFFD, a null list the empty text."""
    shared = _shared(frame, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = parse(shared.value)
        for batch in batches:
            given = batch[ids].fill_null([]) if batch[ids].null_count else batch[ids]
            flat, ends = given.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(given).to_numpy(zero_copy_only=False))])
            texts = [decode_ids(flat[ends[k] : ends[k + 1]], vocabulary).decode("utf-8", "replace") for k in range(len(given))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])

    kept = frame.drop(column)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(column, StringType())]))


def round_trip(docs: DataFrame, content: bytes) -> DataFrame:
    """Every row's (doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids."""
    shared = _shared(docs, content)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = parse(shared.value)
        names = [str(i) for i in range(len(vocabulary.token_bytes))]
        for block in T.blocks(batches, "text", BLOCK_BYTES):
            tokens, number = encode_rows(T.strings(block["text"]), vocabulary)
            at = np.concatenate([[0], np.cumsum(number)])
            hashes, digests = [], []
            for k in range(len(number)):
                ids = tokens[at[k] : at[k + 1]]
                hashes.append(hashlib.sha256(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                digests.append(hashlib.sha256(decode_ids(ids, vocabulary).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(number.astype(np.int64)), pa.array(hashes, pa.string()), pa.array(digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)
