"""Operator 3: fuzzy line deduplication by MinHash.

Method.  Lines are what stands between line feeds, without white space at both
ends; blank lines are left alone.  Equal lines are one item.  An item is its set of
distinct character shingles of length CHARS (a shorter line is one shingle), with a
signature of BANDS * ROWS extremes: least and greatest hashes, in bands of their own.  Lines that share a band are
confirmed by exact Jaccard similarity and linked by distributed union-find (see
``linking``).  Of each component the first line (by doc_id, then line number)
stays; all others go.

Defined cases.  A null text stays null; empty and blank texts stay as they are.
Documents all of whose non-blank lines go are empty after it (``keep_lines`` drops
them on request).  Rows that repeat both doc_id and text are one document and keep
the same lines.  Null doc_ids come first in order.  Extra columns, whatever their
names, are carried by ``keep_lines``; those named n_lines and n_removed are replaced.
Items are told apart by 128 bits of hash and named by numbers of their own.

Scale.  One pass gives about 150 bytes a line; equal lines are summed before the
shuffle, in buffers of fixed width.  Only lines that share a band are read again; a
band has 64 bits, so that strangers share none even among 10**9 lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T
from talkweave.llm.linking import link
from talkweave.llm.tables import Scratch, fresh, small

CHARS = 8
PERCENT = 80
BANDS, ROWS = 14, 4
REGISTERS = BANDS * ROWS
HALF = REGISTERS // 2
#: Standard deviations under the threshold at which signatures rule a pair out.
MARGIN = 4.0
#: Lines that a task remembers to have signed.
SIGNED = 1 << 18
#: Pairs of lines that are compared at once.
PAIRS = 1 << (64 - T.HASH_BITS)
#: The signature: a long column for each band, of ROWS registers of 16 bits.
SIGNATURE = [f"s{i}" for i in range(BANDS)]


#: Outer white space of a line, and how many values at either end are tried for all lines at once.
SPACES, OUTER = bytes(np.flatnonzero(T.IS_SPACE).tolist()), 16


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each non-blank line without outer white space, its row, and its number in the row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 4
    feeds = np.flatnonzero(data == 0x0A)
    start, end = np.sort(np.concatenate([at[:-1], feeds + 1])), np.sort(np.concatenate([feeds, at[1:]]))
    row = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(feeds, at)) + 1)
    number = np.arange(len(row)) - (np.searchsorted(row, np.arange(len(at) - 1)))[row]
    for step in range(OUTER + 1):
        some = np.flatnonzero(start < end)
        first = some[T.IS_SPACE[data[start[some]]]]
        last = some[T.IS_SPACE[data[end[some] - 1]]]
        if not len(first) and not len(last):
            break
        if step == OUTER:  # lines with much white space, one by one
            for k in np.union1d(first, last).tolist():
                line = data[start[k] : end[k]].tobytes()
                start[k] += len(line) - len(line.lstrip(SPACES))
                end[k] = start[k] + len(line.strip(SPACES))
            break
        end[last] -= 1
        first = first[start[first] < end[first]]
        start[first] += 1
    full = np.flatnonzero(start < end)
    return start[full], end[full], row[full], number[full]


def count_lines(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of non-blank lines of each row."""
    return np.bincount(lines(data, at)[2], minlength=len(at) - 1).astype(np.int32)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of UTF-8 begin, and the number that the bytes of each make."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[begins].astype(np.uint64)
    wide = np.flatnonzero(points >= 0xC0)
    first, more = begins[wide], np.append(data, np.zeros(3, np.uint8))
    for k in (1, 2, 3):
        byte = more[first + k]
        on = (byte & 0xC0) == 0x80
        wide, first = wide[on], first[on]
        points[wide] = (points[wide] << np.uint64(8)) | byte[on]
    return begins, points


def windows(points: np.ndarray) -> np.ndarray:
    """A polynomial modulo 2**64 of each CHARS values in a row from every place on, zeros after the last; CHARS is a power of two."""
    h = np.zeros(len(points) + CHARS - 1, np.uint64)
    np.add(points, np.uint64(1), out=h[: len(points)])
    width = 1
    while width < CHARS:
        ahead = h[width:]
        h = h[:-width] * np.uint64(pow(int(T.BASES[0]), width, 1 << 64))
        h += ahead
        width *= 2
    return h


def shingle_sets(data: np.ndarray, start: np.ndarray, end: np.ndarray, spans: T.Spans | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of each span (with repeats) and their number; spans ascend and don't overlap.

    Windows over the whole piece are hashed in one go, and those inside spans are picked.
    """
    begins, points = code_points(data)
    first, last = np.searchsorted(begins, start), np.searchsorted(begins, end)
    whole = last - first >= CHARS
    number = np.where(whole, last - first - CHARS + 1, 1)
    inside = np.zeros(len(begins) + 1, np.int8)
    inside[first] = 1
    inside[np.where(whole, last - CHARS + 1, first + 1)] -= 1
    picked = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    hashes = windows(points)[picked]
    short = np.flatnonzero(~whole)
    if len(short):
        hashes[(np.cumsum(number) - number)[short]] = (spans or T.Spans(data)).sum(start[short], end[short])
    return T.mix(hashes), number


def _constants() -> tuple[np.ndarray, np.ndarray]:
    r = T.mix(np.arange(101, 2 * HALF + 101, dtype=np.uint64))
    return (r[:HALF] >> np.uint64(32)).astype(np.uint32), (r[HALF:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def extremes(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """REGISTERS extremes of each row of hashes, mixed down to 16 bits: minima of as many functions as half of them, then their maxima.

    Both ends of one function agree for a share of pairs that is the similarity, as minima of two
    functions do; they depend on each other only in that one misses rather where the other
    agrees, and they are in different bands.
    """
    out = np.empty((REGISTERS, len(number)), np.uint32)
    starts = np.cumsum(number) - number
    high, room = (hashes >> np.uint64(32)).astype(np.uint32), np.empty(len(hashes), np.uint32)
    for i, (s, m) in enumerate(zip(*_constants(), strict=True)):
        np.bitwise_xor(high, s, out=room)
        np.multiply(room, m, out=room)
        np.minimum.reduceat(room, starts, out=out[i])
        np.maximum.reduceat(room, starts, out=out[i + HALF])
    return (T.mix(out.T.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _signed(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: its document, number and 128-bit hash; the first of equal ones in a piece has the signature, unless the task has signed it before."""
    schema = "doc_id long, text_hash long, line int, h1 long, h2 long, " + ", ".join(f"{s} long" for s in SIGNATURE)
    names = [f.split()[0] for f in schema.split(", ")]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                start, end, row, number = lines(data, at)
                if not len(start):
                    continue
                spans = T.Spans(data)
                h1 = spans.hash(start, end)
                _, firsts, copy = np.unique(h1, return_index=True, return_inverse=True)
                hashes, count = shingle_sets(data, start[np.sort(firsts)], end[np.sort(firsts)], spans)
                # the second half is of the shingles: lines are equal if their sequences and their shingles are
                half = T.mix(np.add.reduceat(hashes, np.cumsum(count) - count))
                h2 = half[np.argsort(np.argsort(firsts))[copy]]
                firsts.sort()
                if len(signed) > SIGNED:
                    signed.clear()
                new = np.array([x not in signed for x in T.mix(h1[firsts] ^ half).tolist()], bool)
                signed.update(T.mix(h1[firsts] ^ half).tolist())
                firsts = firsts[new]
                signature = np.ascontiguousarray(extremes(hashes[np.repeat(new, count)], count[new])).view(np.int64)
                rest = np.ones(len(start), bool)
                rest[firsts] = False

                def spread(values: np.ndarray) -> pa.Array:
                    full = np.zeros(len(start), np.int64)  # noqa: B023
                    full[firsts] = values  # noqa: B023
                    return pa.array(full, mask=rest)  # noqa: B023

                owner = pa.array(row)
                columns = [part["doc_id"].take(owner), part["text_hash"].take(owner), pa.array(number.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *map(spread, signature.T)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text", "text_hash").mapInArrow(sign, schema)


def _possible(_: np.ndarray, __: np.ndarray, sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    t = PERCENT / 100
    return T.true_bits(sig_a == sig_b) >= REGISTERS * (t - MARGIN * np.sqrt(t * (1 - t) / REGISTERS))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, members) of the wanted lines, members being their text; wanted: doc_id, text_hash, and the lines and ids in ``wanted``."""
    places = wanted.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    held = docs.join(small(places, 16 + 16 * F.size("wanted")), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))).select("text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in T.pieces(batch, "text"):
                start, end, row, number = lines(data, at)
                lists = part["wanted"]
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                line, ids = flat.field("line").to_numpy(), flat.field("id").to_numpy()
                pick = np.searchsorted(row * (1 << 32) + number, owner * (1 << 32) + line)
                found = [data[a:b].tobytes() for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found, pa.binary())], ["id", "members"])

    return held.mapInArrow(cut, "id long, members binary")


def _unpack(found: list[bytes]) -> list[np.ndarray]:
    """The shingle sets of lines."""
    out: list[np.ndarray] = []
    for k in range(0, len(found), 1024):
        part = found[k : k + 1024]
        at = np.concatenate([[0], np.cumsum([len(x) for x in part])])
        hashes, number = T.distinct(*shingle_sets(np.frombuffer(b"".join(part), np.uint8), at[:-1], at[1:]))
        out += np.split(hashes, np.cumsum(number)[:-1])
    return out


def _similar(side_a: list[bytes], side_b: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of lines have 100 * intersection >= percent * union, from their shingles sorted once: pair, hash, side."""
    out = []
    for k in range(0, len(side_a), PAIRS):
        part = [x for pair in zip(side_a[k : k + PAIRS], side_b[k : k + PAIRS], strict=True) for x in pair]
        at = np.concatenate([[0], np.cumsum([len(x) for x in part])])
        hashes, number = shingle_sets(np.frombuffer(b"".join(part), np.uint8), at[:-1], at[1:])
        # of 64 bits 6 are the pair's and the last one is the side's
        line = np.arange(len(part), dtype=np.uint64)
        hashes >>= np.uint64(64 - T.HASH_BITS)
        hashes &= ~np.uint64(1)
        hashes |= np.repeat((line >> np.uint64(1) << np.uint64(T.HASH_BITS)) | (line & np.uint64(1)), number)
        hashes.sort()
        change = hashes[1:] ^ hashes[:-1]
        pairs = np.append(0, np.searchsorted(hashes, np.arange(1, len(part) // 2, dtype=np.uint64) << np.uint64(T.HASH_BITS)))
        both = np.add.reduceat(np.append(1, change != 0), pairs)
        union = np.add.reduceat(np.append(1, change > 1), pairs)
        out.append(100 * (both - union) >= percent * union)
    return np.concatenate(out)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, removed): the numbers of the lines that go, of documents that have any.

    docs: doc_id long, text, text_hash (xxhash64 of the text).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    signed = scratch.save(_signed(docs), "lines", hashes=True)
    place = F.struct("doc_id", "text_hash", "line")
    largest = [F.max(c).alias(c) for c in SIGNATURE]  # equal lines have equal values, or none
    summed = signed.groupBy("h1", "h2").agg(F.count("*").alias("copies"), *largest)
    classes = scratch.save(summed.withColumn("id", F.monotonically_increasing_id()), "classes", hashes=True)
    bands = F.array(*[F.xxhash64(F.lit(i), s) for i, s in enumerate(SIGNATURE)])
    items = classes.select("id", F.lit(0).cast("long").alias("size"), F.array(*SIGNATURE).alias("signature"), bands.alias("buckets"))

    def sets_of(ids: DataFrame) -> DataFrame:
        named = scratch.save(classes.select("id", "h1", "h2").join(small(ids), "id"), "named")
        copies = signed.select("doc_id", "text_hash", "line", "h1", "h2").join(small(named), ["h1", "h2"])
        first = copies.groupBy("id").agg(F.min(place).alias("first")).select("id", "first.*")
        return _sets(docs, scratch.save(first.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line", "id")).alias("wanted")), "places"))

    roots = link(items, sets_of, _possible, np.dtype(np.uint16), PERCENT, scratch, _unpack, _similar)
    # only lines with copies or links can go
    touched = classes.select("id", "h1", "h2", "copies").join(small(roots.withColumnRenamed("node", "id")), "id", "left").where("copies > 1 OR root IS NOT NULL")
    touched = scratch.save(touched.select("h1", "h2", F.coalesce("root", "id").alias("root")), "touched")
    several = scratch.save(signed.select("doc_id", "text_hash", "line", "h1", "h2").join(small(touched), ["h1", "h2"]).drop("h1", "h2"), "several")
    keepers = scratch.save(several.groupBy("root").agg(F.min(place).alias("keeper")), "keepers")
    goes = several.join(small(keepers, F.lit(48)), "root").where(~place.eqNullSafe(F.col("keeper")))
    return scratch.finish(goes.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("removed")))


def _rewritten(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with n_lines and n_removed, and their texts without the removed lines."""
    doc, hashed, gone_lines = fresh(docs, "_doc", "_hashed", "_removed")
    removed = removed.withColumnsRenamed({"doc_id": doc, "text_hash": hashed, "removed": gone_lines})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(hashed))
    joined = docs.join(small(removed, 16 + 4 * F.size(gone_lines)), same, "left").drop(doc, hashed)
    joined = joined.withColumns({"n_lines": F.lit(0), "n_removed": F.coalesce(F.size(gone_lines), F.lit(0))})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in T.pieces(batch, "text", 1 << 20):
                count = count_lines(data, at)
                gone = part["n_removed"].to_numpy() > 0
                texts = []
                for text, numbers in zip(part["text"].filter(pa.array(gone)).to_pylist(), part[gone_lines].filter(pa.array(gone)).to_pylist(), strict=True):
                    drop = set(numbers)
                    texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | {"n_lines": pa.array(count)}
                columns["text"] = pc.replace_with_mask(part["text"], pa.array(gone), pa.array(texts, part["text"].type))
                del columns[gone_lines]
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return joined.mapInArrow(cut, joined.drop(gone_lines).schema)


def keep_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The documents (all columns) without repeated lines, plus n_lines and n_removed (non-blank lines before, and removed).

    drop_emptied leaves out documents that had lines and kept none.
    """
    docs = docs.drop("n_lines", "n_removed")
    out = _rewritten(docs, removed_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))))
    return out.where("n_removed = 0 OR n_removed < n_lines") if drop_emptied else out
