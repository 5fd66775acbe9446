"""Operator 4: exact cosine links between embeddings by PCA-ordered tiled comparison.

Method.  Vectors are scaled to unit length and turned into the basis of their
principal directions, fitted on about SAMPLE of them (any orthonormal basis gives
the same results; this one puts most of the length in front).  Sorted by the angle
to the first direction they are cut into tiles of TILE vectors.  For two tiles,
products of the leading LEAD dimensions are accumulated first; with the norms of
the rest as a bound of what can still come (Cauchy-Schwarz), only pairs that can
reach the threshold go on to the remaining dimensions.  Tiles whose angles to the
first direction differ by more than the threshold's angle are not compared at
all.  Products within 1e-9 of the threshold are decided by the cosine of the
vectors as given, in double precision.

Equal vectors are compared once and counted by their number.  A comparison of two
tiles returns, per vector, its number of links, and the edges of a spanning
forest, so no result grows with the square of a group.

Defined cases.  Null, empty or zero vectors, and those with null or non-finite
components, are linked with nothing.  Vectors of different lengths are not linked.
Rows are linked by their vectors alone: rows of one vec_id, or of none, with different
vectors are linked each by its own, and a component is named by its smallest vec_id
(by none, if all are null).  Extra columns, labels included, are ignored.

Scale.  All pairs are compared because links are exact; the work is cut into equal
tile pairs of bounded memory; a task holds one tile and takes its partners as they come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.components import connected_components
from talkweave.llm.tables import Scratch

COSINE = 0.9
TILE = 4096
LEAD = 16
SAMPLE = 4_000
STRIP = 512
CLOSE = 1e-9


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(1, keepdims=True)  # against overflow and underflow of squares
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def compare(raw_a: np.ndarray, raw_b: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places (i in a, j in b) in strips of a; of a tile with itself every pair once."""
    a, b = _unit(raw_a) @ basis, _unit(raw_b) @ basis
    lead = min(LEAD, a.shape[1])
    rest_a, rest_b = np.sqrt((a[:, lead:] ** 2).sum(1)), np.sqrt((b[:, lead:] ** 2).sum(1))
    front = np.ascontiguousarray(b[:, :lead].T)
    for k in range(0, len(a), STRIP):
        part = a[k : k + STRIP]
        bound = part[:, :lead] @ front
        able = bound + np.outer(rest_a[k : k + STRIP], rest_b) >= threshold - CLOSE
        if same:
            able &= np.arange(len(b)) > np.arange(k, k + len(part))[:, None]
        if np.count_nonzero(able) > able.size // 8:
            i, j = np.nonzero(able & (part @ b.T >= threshold - CLOSE))
        else:
            i, j = np.nonzero(able)
            done, product = lead, bound[i, j]
            while done < a.shape[1] and len(i):
                more = slice(done, 2 * done)
                product = product + np.einsum("ij,ij->i", part[i, more], b[j, more])
                done = min(2 * done, a.shape[1])
                left = np.sqrt((part[:, done:] ** 2).sum(1))[i] * np.sqrt((b[:, done:] ** 2).sum(1))[j]
                ok = product + left >= threshold - CLOSE
                i, j, product = i[ok], j[ok], product[ok]
        product = np.einsum("ij,ij->i", part[i], b[j])
        unsure = np.flatnonzero(np.abs(product - threshold) <= CLOSE)
        ok = product >= threshold
        ok[unsure] = _cosine(raw_a[i[unsure] + k], raw_b[j[unsure]]) >= threshold
        yield i[ok] + k, j[ok]


def _linked(classes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, other, links) of distinct vectors: counts have other null, forest edges have links 0.

    classes: id, n, dims, embedding.  The basis is fitted to the most frequent length; vectors of
    other lengths keep their own, as every orthonormal basis gives the same links.
    """
    context = classes.sparkSession.sparkContext
    main = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if main is None:
        return classes.select(F.col("id").alias("node"), F.col("id").alias("other"), F.col("n").alias("links"))
    sample = classes.where((F.col("dims") == main["dims"]) & (F.pmod(F.xxhash64("embedding"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, SAMPLE / main["count"])))).select("embedding").toPandas()
    basis = np.eye(main["dims"])
    if len(sample):
        unit = _unit(np.array(sample["embedding"].tolist(), np.float64))
        basis = np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy()
    shared = context.broadcast(basis)

    def own(dims: int) -> np.ndarray:
        return shared.value if len(shared.value) == dims else np.eye(dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["dims"].to_numpy()
            for dims in np.unique(length).tolist():
                part = batch.filter(pa.array(length == dims))
                raw = part["embedding"].flatten().to_numpy().reshape(-1, dims)
                angle = np.arccos(np.clip(_unit(raw) @ own(dims)[:, 0], -1, 1))
                yield pa.RecordBatch.from_arrays([part["id"], part["n"], part["dims"], pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(angle)], ["id", "n", "dims", "raw", "angle"])

    placed = scratch.save(classes.select("id", "n", "dims", "embedding").mapInArrow(place, "id long, n long, dims int, raw binary, angle double"), "placed")
    parts = max(1, math.ceil(placed.count() / (4 * TILE)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = tile = 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            angle = t["angle"].to_numpy()
            return pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() * (1 << 24) + tile]), t["dims"].combine_chunks()[:1], pa.array([float(angle.min())]), pa.array([float(angle.max())]),
                *[pa.array([x], pa.binary()) for x in (t["id"].to_numpy().tobytes(), t["n"].to_numpy().tobytes(), b"".join(t["raw"].to_pylist()))],
            ], ["tile", "dims", "low", "high", "ids", "ns", "raws"])

        for batch in batches:
            while batch.num_rows:
                length = batch["dims"].to_numpy()
                if size and held[0]["dims"][0].as_py() != length[0]:
                    yield out()
                    held, size, tile = [], 0, tile + 1
                same = int(np.argmax(length != length[0])) or batch.num_rows  # a tile holds one length
                head = batch.slice(0, min(TILE - size, same))
                held.append(head)
                size += head.num_rows
                batch = batch.slice(head.num_rows)
                if size == TILE:
                    yield out()
                    held, size, tile = [], 0, tile + 1
        if size:
            yield out()

    ordered = placed.repartitionByRange(parts, "dims", "angle").sortWithinPartitions("dims", "angle")
    tiles = scratch.save(ordered.mapInArrow(pack, "tile long, dims int, low double, high double, ids binary, ns binary, raws binary"), "tiles")

    reach = math.acos(threshold) + 1e-6
    bucket = lambda x: F.floor(F.col(x) / reach)
    left = tiles.select("dims", F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(bucket("low") - 1, bucket("high") + 1)).alias("bucket"))
    right = tiles.select("dims", F.col("tile").alias("b"), "low", "high", F.explode(F.sequence(bucket("low"), bucket("high"))).alias("bucket"))
    near = (F.col("low") - F.col("high_a") <= reach) & (F.col("low_a") - F.col("high") <= reach)
    pairs = left.join(right, ["dims", "bucket"]).where(near & (F.col("a") <= F.col("b"))).select("dims", "a", "b").distinct()
    count = tiles.count()
    # a task holds the left tile of a run of pairs and takes the right ones as they come
    groups = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(max(1, 64 // count))))
    lefts = groups.select("dims", "a", "part").distinct().select("dims", "a", "part", F.col("a").alias("tile"), F.lit(0).alias("right"))
    rows = lefts.unionByName(groups.select("dims", "a", "part", F.col("b").alias("tile"), F.lit(1).alias("right"))).join(tiles.select("tile", "ids", "ns", "raws"), "tile")
    rows = rows.repartition(max(1, min(count * max(1, 64 // count), 4096)), "a", "part").sortWithinPartitions("a", "part", "right", "tile")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, mine = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch[name][row].as_buffer(), kind)  # noqa: B023, E731
                dims = batch["dims"][row].as_py()
                tile = (get("ids", np.int64), get("ns", np.int64), get("raws", np.float64).reshape(-1, dims))
                if not batch["right"][row].as_py():
                    mine = tuple(x.copy() for x in tile)
                    basis = own(dims)
                    continue
                same = batch["a"][row] == batch["tile"][row]
                (ids_a, n_a, raw_a), (ids_b, n_b, raw_b) = mine, tile
                links_a, links_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
                shift = 0 if same else len(ids_a)
                nodes = ids_a if same else np.concatenate([ids_a, ids_b])
                forest = np.arange(len(nodes))
                for i, j in compare(raw_a, raw_b, basis, threshold, same):
                    np.add.at(links_a, i, n_b[j])
                    np.add.at(links_a if same else links_b, j, n_a[i])
                    forest = _roots(len(nodes), np.concatenate([np.arange(len(nodes)), i]), np.concatenate([forest, j + shift]))
                links = links_a if same else np.concatenate([links_a, links_b])
                some, edge = np.flatnonzero(links), np.flatnonzero(forest != np.arange(len(nodes)))
                node = np.concatenate([nodes[some], nodes[edge]])
                other = pa.array(np.concatenate([np.zeros(len(some), np.int64), nodes[forest[edge]]]), mask=np.arange(len(node)) < len(some))
                yield pa.RecordBatch.from_arrays([pa.array(node), other, pa.array(np.concatenate([links[some], np.zeros(len(edge), np.int64)]))], ["node", "other", "links"])

    return rows.select("dims", "a", "tile", "right", "ids", "ns", "raws").mapInArrow(work, "node long, other long, links long")


def near_links(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Every row's (vec_id, n_links, component_id, kept): vectors with a cosine of at least the threshold are linked.

    vectors: vec_id, embedding (array of float or double).
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(usable, F.col("embedding")))
    # distinct vectors have numbers of their own: vec_ids may be null or repeated
    classes = rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = scratch.save(classes.withColumns({"dims": F.size("embedding"), "id": F.monotonically_increasing_id()}), "classes")
    found = scratch.save(_linked(classes, threshold, scratch), "found")
    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    judged = classes.join(links.withColumnRenamed("node", "id"), "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    judged = judged.select("embedding", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    names = judged.groupBy("root").agg(F.min("first").alias("name"))
    named = judged.join(names, "root").select("embedding", "links", "name", F.lit(True).alias("linked"))
    out = rows.join(named, "embedding", "left").withColumn("component_id", F.when(F.col("linked"), F.col("name")).otherwise(F.col("vec_id")))
    return scratch.finish(out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")))
