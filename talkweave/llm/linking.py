"""Exact groups of near-duplicates from a locality-sensitive bucket table.

``link`` finds the components of "similarity at least the threshold" among the
pairs that share a bucket, without writing all pairs of a bucket:

1. star round: in every bucket the member with the smallest id is compared with the
   others, by sizes and signatures first and then on the full sets;
2. rest round: in buckets whose other members are still in several components, the common
   set members of all pairs of *different* components are counted inside tasks, by
   an inverted index over a block of bounded size; components that a link joins
   are one from there on, so a task returns a spanning forest at most.

Members of one component need no further comparison, so no component is lost by
leaving the inner pairs out, and what is written stays in proportion to members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T
from talkweave.llm.components import connected_components
from talkweave.llm.tables import Scratch, small

#: Members of a bucket per block in the rest round.
BLOCK = 1024
#: Bytes of members that a task of the rest round compares at once, if no single group has more.
CHUNK = 4 << 20

#: May the pair reach the threshold?  Gets sizes and signatures (rows of a matrix) of both sides.
Possible = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


#: Sorted distinct 64-bit hashes of each of a list of stored items.
Unpack = Callable[[list[bytes]], list[np.ndarray]]


#: Which pairs of stored items have 100 * intersection >= percent * union?
Similar = Callable[[list[bytes], list[bytes], int], np.ndarray]


def raw_hashes(items: list[bytes]) -> list[np.ndarray]:
    """Items stored as the bytes of their sorted hashes."""
    return [np.frombuffer(x, np.uint64) for x in items]


def _jaccard(unpack: Unpack) -> Similar:
    """Compares the sets that ``unpack`` gives."""

    def similar(side_a: list[bytes], side_b: list[bytes], percent: int) -> np.ndarray:
        sides = [unpack(x) for x in (side_a, side_b)]
        number = np.array([len(x) + len(y) for x, y in zip(*sides, strict=True)])
        union = T.distinct(np.concatenate([v for both in zip(*sides, strict=True) for v in both]), number)[1]
        return 100 * (number - union) >= percent * union

    return similar


def _matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """Signatures as rows: binary values, or lists of longs that hold the same bytes."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().view(kind).reshape(len(column), -1)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _plausible(pairs: DataFrame, items: DataFrame, possible: Possible, kind: np.dtype) -> DataFrame:
    """Pairs (a, b) that sizes and signatures don't rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(items.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("signature").alias(f"sig_{side}")), side)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = possible(b["size_a"].to_numpy(), b["size_b"].to_numpy(), _matrix(b["sig_a"], kind), _matrix(b["sig_b"], kind))
                yield b.select(["a", "b"]).filter(pa.array(ok))
        T.release()

    return pairs.select("a", "b", "size_a", "size_b", "sig_a", "sig_b").mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, similar: Similar) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("members").alias(f"set_{side}")), side)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            yield b.select(["a", "b"]).filter(pa.array(similar(b["set_a"].to_pylist(), b["set_b"].to_pylist(), percent)))
            T.release()

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(keep, "a long, b long")


#: Bytes of bucket names that a task deals out or sorts at once.
NAMES = 8 << 20


def _shared(items: DataFrame) -> DataFrame:
    """The buckets (each once) of two items or more.

    Names alone are shuffled, packed by range of their values and sorted in tasks; a name goes at
    most twice from each block of items, so that a bucket of very many is no more than a few rows.
    """
    one = items.select(F.size("buckets")).first()  # the other items have about as many
    ranges = max(1, -(-8 * items.count() * (one[0] if one else 0) // NAMES))
    edges = np.array([-(-(i << 64) // ranges) for i in range(ranges)], np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            names = np.concatenate(held)
            held.clear()
            names.sort()
            kept = np.ones(len(names), bool)
            kept[2:] = names[2:] != names[:-2]
            names = names[kept]
            number = np.diff(np.append(np.searchsorted(names, edges), len(names)))
            some = np.flatnonzero(number)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), T.binaries(names, number[some])], ["range", "names"])

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                held.append(batch["buckets"].slice(k, 4096).flatten().to_numpy().view(np.uint64))
                if sum(map(len, held)) * 8 >= NAMES:
                    yield packed()
        if held:
            yield packed()
        T.release()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = -1

        def found() -> pa.RecordBatch:
            names = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            names.sort()
            again = names[1:][names[1:] == names[:-1]]
            return pa.RecordBatch.from_arrays([pa.array(again[np.append(True, again[1:] != again[:-1])[: len(again)]].view(np.int64))], ["bucket"])

        for batch in batches:
            for number, names in zip(batch["range"].to_pylist(), batch["names"], strict=True):
                if number != at:
                    yield found()
                    at = number
                held.append(np.frombuffer(names.as_buffer(), np.uint64).copy())
        yield found()
        T.release()

    dealt = items.select("buckets").mapInArrow(deal, "range int, names binary")
    return dealt.repartition("range").sortWithinPartitions("range").mapInArrow(repeated, "bucket long")


#: Pairs of members whose signatures are compared at once.
PAIRS = 1 << 16


def _plausible_groups(begins: np.ndarray, ends: np.ndarray, roots: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, possible: Possible) -> list[tuple[int, int, np.ndarray]]:
    """Groups (begin, end) with the members (places in the group) that some member of another component may be linked with."""
    found = []
    number = ends - begins
    for low, high in zip(begins[number * number > PAIRS].tolist(), ends[number * number > PAIRS].tolist(), strict=True):
        n, able = high - low, np.zeros(high - low, bool)
        step = max(1, PAIRS // n)
        for k in range(0, n, step):
            rows = slice(k, min(k + step, n))
            # the pairs before the row were tried from their other side, and those of two that are marked add nothing
            wanted = (roots[low:high][rows, None] != roots[low:high]) & ~(able[rows, None] & able) & (np.arange(n)[rows, None] < np.arange(n))
            i, j = np.nonzero(wanted)
            i += low + k
            j += low
            ok = possible(sizes[i], sizes[j], signatures[i], signatures[j])
            able[i[ok] - low] = able[j[ok] - low] = True
        found.append((low, high, np.flatnonzero(able)))
    for n in np.unique(number[number * number <= PAIRS]).tolist():
        starts, (a, b) = begins[number == n], np.triu_indices(n, 1)
        step = max(1, PAIRS // max(len(a), 1))
        for k in range(0, len(starts), step):
            i, j = (starts[k : k + step, None] + a).ravel(), (starts[k : k + step, None] + b).ravel()
            apart = np.flatnonzero(roots[i] != roots[j])
            i, j = i[apart], j[apart]
            ok = possible(sizes[i], sizes[j], signatures[i], signatures[j])
            able = np.unique(np.concatenate([i[ok], j[ok]]))
            owner = starts[np.searchsorted(starts, able, "right") - 1]
            for part in np.split(np.arange(len(able)), np.flatnonzero(np.diff(owner)) + 1):
                if len(part):
                    low = int(owner[part[0]])
                    found.append((low, low + n, able[part] - low))
    return [f for f in found if len(f[2]) > 1]


#: Cells of a table of members by values that is multiplied with itself.
DENSE = 1 << 16


def _forest(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, enough to join all that are linked.

    Common values are counted by a product of tables if these are small, else by an inverted index, for all
    members but those of the largest component.
    """
    number = np.array([len(x) for x in sets])
    owner, value = np.repeat(np.arange(len(sets)), number), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owners = owner[order]
    new = np.append(True, value[order][1:] != value[order][:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(value)))
    term = np.empty(len(value), np.int64)
    term[order] = np.cumsum(new) - 1
    found: list[tuple[int, int]] = []
    label = np.unique(roots, return_inverse=True)[1]
    if len(sets) * len(first) <= DENSE:
        table = np.zeros((len(sets), len(first)), np.float32)
        table[owner, term] = 1
        common = table @ table.T
        near = (100 * common >= percent * (number[:, None] + number - common)) & (label[:, None] < label)
        for i, j in np.argwhere(near).tolist():
            if label[i] != label[j]:
                found.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
        return found
    at = np.concatenate([[0], np.cumsum(number)])
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        t = term[at[i] : at[i + 1]]
        n = length[t]
        place = np.repeat(first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owners[place], minlength=len(sets))
        near = np.flatnonzero((100 * common >= percent * (number + number[i] - common)) & (label != label[i]))
        while len(near):
            found.append((ids[i], ids[near[0]]))
            label[label == label[near[0]]] = label[i]
            near = near[label[near] != label[i]]
    return found


def _rest(members: DataFrame, percent: int, possible: Possible, kind: np.dtype, unpack: Unpack) -> DataFrame:
    """Links between different components within buckets, enough of them to join all components that are linked there.

    members: bucket, n (rows of the bucket), id, root, size, signature, members.  A bucket of n
    members is cut into ceil(n / BLOCK) parts by hash before anything is shuffled by bucket;
    each pair of parts is one group, so a group has at most about two blocks of rows.  A task
    takes the groups of its partition as they come, about CHUNK bytes at a time: sizes and
    signatures first, then the full sets of the members that these leave.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumns({"part": F.pmod(F.xxhash64("id"), parts).cast("int"), "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    key = ["bucket", "low", "high"]
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).select(*key, "id", "root", "size", "signature", "members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            keys = np.stack([table[c].to_numpy() for c in key])
            begins = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
            ids, roots, sizes = (table[c].to_numpy() for c in ("id", "root", "size"))
            signatures = _matrix(table["signature"].combine_chunks() if isinstance(table["signature"], pa.ChunkedArray) else table["signature"], kind)
            found: list[tuple[int, int]] = []
            groups = _plausible_groups(begins, np.append(begins[1:], len(ids)), roots, sizes, signatures, possible)
            if groups:
                rows = np.concatenate([low + able for low, _, able in groups])
                sets, k = unpack(table["members"].take(pa.array(rows)).to_pylist()), 0
                for _, _, able in groups:
                    part = rows[k : k + len(able)]
                    found += _forest(ids[part], roots[part], sets[k : k + len(able)], percent)
                    k += len(able)
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.nbytes < CHUNK:
                continue
            last = [held[c][-1] for c in key]
            whole = held.num_rows - 1
            while whole >= 0 and [held[c][whole] for c in key] == last:
                whole -= 1
            if whole >= 0:  # the last group may go on in the next batch
                yield links(held.slice(0, whole + 1))
                held = held.slice(whole + 1)
        if held is not None:
            yield links(held)
        held = None
        T.release()

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a long, b long").distinct()


def link(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], possible: Possible, kind: np.dtype, percent: int, scratch: Scratch, unpack: Unpack = raw_hashes, similar: Similar | None = None) -> DataFrame:
    """(node, root) for every item that is linked with another, root being the smallest id.

    items: id long (unique), size long, signature binary, buckets array<long>.
    sets_of: from a frame of ids to (id, members binary), which ``unpack`` turns to sets; repeated rows do no harm.
    similar: the same comparison as of unpacked sets, if there is a faster one.
    """
    shared = scratch.save(_shared(items), "shared")
    placed = scratch.save(items.select("id", F.explode("buckets").alias("bucket")).join(small(shared), "bucket").select("bucket", "id"), "placed")
    sizes = scratch.save(placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1"), "sizes")
    placed = scratch.save(placed.join(small(sizes), "bucket").select("bucket", "id", "hub", "n"), "buckets")
    # few items share a bucket, so that the joins below don't shuffle all signatures
    sharing = scratch.save(placed.select("id").distinct(), "sharing")
    items = scratch.save(items.select("id", "size", "signature").join(small(sharing), "id"), "members")

    def pairs(frame: DataFrame) -> DataFrame:
        return frame.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()

    first = scratch.save(_plausible(pairs(placed), items, possible, kind), "star")
    # in a bucket of two the star round decides, so an implausible pair needs no sets
    needed = first.select(F.explode(F.array("a", "b")).alias("id")).unionByName(placed.where("n > 2").select("id")).distinct()
    sets = scratch.save(sets_of(scratch.save(needed, "needed")), "sets")
    links = scratch.save(_confirmed(first, sets, percent, similar or _jaccard(unpack)), "links")
    roots = connected_components(links, scratch)
    named = small(roots.withColumnRenamed("node", "id"))

    # the star round has decided all pairs with the hub; equal sets of other members are looked at once
    left = placed.where("id <> hub").select("bucket", "id", F.col("n").alias("all")).join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))
    undecided = left.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.bit_xor(F.xxhash64("id")).alias("digest"))
    undecided = undecided.where("low < high").groupBy("n", "first", "last", "digest").agg(F.min("bucket").alias("bucket")).select("bucket")
    left = scratch.save(left.join(undecided, "bucket").select("bucket", F.col("all").alias("n"), "id", "root"), "undecided")
    if left.isEmpty():
        return roots
    more = scratch.save(_rest(left.join(items, "id").join(sets, "id"), percent, possible, kind, unpack), "links")
    if more.isEmpty():
        return roots
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)
