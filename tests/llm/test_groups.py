"""Large groups of near copies and components that are stars: work stays in proportion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from talkweave.llm import bpe_codec, line_dedup, linking, minhash_dedup, text
from talkweave.llm.components import connected_components
from talkweave.llm.queries import vocabulary
from talkweave.llm.tables import Scratch
from talkweave.llm.vocabulary import parse


def test_large_group_tries_few_pairs():
    """Of a group whose members are all plausible, each needs to be tried with one other only."""
    n, tried = 900, []

    def possible(size_a, size_b, sig_a, sig_b):
        tried.append(len(size_a))
        return np.ones(len(size_a), bool)

    signatures = np.zeros((n, 4), np.uint16)
    found = linking._plausible_groups(np.array([0]), np.array([n]), np.arange(n), np.ones(n, np.int64), signatures, possible)
    assert [(low, high, able.tolist()) for low, high, able in found] == [(0, n, list(range(n)))]
    assert sum(tried) <= linking.PAIRS


def test_large_group_keeps_every_plausible_member():
    """Members of another component with an equal signature are marked, from whichever side they are tried."""
    rng = np.random.default_rng(5)
    n = 700
    signatures, roots = rng.integers(0, 400, (n, 1)).astype(np.uint16), rng.integers(0, 300, n)
    found = linking._plausible_groups(np.array([0]), np.array([n]), roots, np.ones(n, np.int64), signatures, lambda _a, _b, x, y: (x == y).all(1))
    pairs = (signatures == signatures.T) & (roots[:, None] != roots)
    assert found[0][2].tolist() == np.flatnonzero(pairs.any(1)).tolist()


def test_slope_decides_as_the_estimate():
    """The slope at the least similarity says on which side of it the estimate lies."""
    rng = np.random.default_rng(3)
    n, regs = 4000, minhash_dedup.REGISTERS
    size_a = rng.integers(50, 400, n)
    size_b = np.maximum(1, (size_a * rng.uniform(0.8, 1.25, n)).astype(np.int64))
    sig_a = rng.integers(20000, 30000, (n, regs)).astype(np.uint16)
    change = rng.random((n, regs)) < rng.uniform(0, 0.7, (n, 1))
    sig_b = np.where(change, sig_a.astype(int) + rng.integers(-50, 51, (n, regs)), sig_a).astype(np.uint16)
    t = minhash_dedup.PERCENT / 100
    least = t - minhash_dedup.MARGIN * np.sqrt(t * (1 - t) / regs)
    estimate = minhash_dedup.similarity(size_a.astype(float), size_b.astype(float), sig_a, sig_b)
    sizes = 100 * np.minimum(size_a, size_b) >= minhash_dedup.PERCENT * np.maximum(size_a, size_b)
    told = minhash_dedup.possible(minhash_dedup.PERCENT)(size_a, size_b, sig_a, sig_b)
    clear = np.abs(estimate - least) > 0.001
    assert 200 < told.sum() < n - 200
    assert (told == (sizes & (estimate >= least)))[clear].all()


def test_stars_need_no_round(spark):
    """Edges that are stars already are not written a second time."""
    scratch = Scratch(spark, "stars")
    edges = spark.createDataFrame([(1, 2), (3, 1), (1, 3), (7, 9), (7, 7)], "a long, b long")
    assert sorted(map(tuple, connected_components(edges, scratch).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]
    assert scratch.count == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 40)], "a long, b long")
    assert {r.root for r in connected_components(chain, scratch).collect()} == {1}


def test_lines_and_their_count():
    """Lines are cut and counted as by split and strip, with much outer white space too."""
    rows = ["", "\n", " a \n\n\tb", "a" * 300, " " * 50 + "x" + "\t" * 40 + "\n" + " " * 90, "\x0b\x0c\r\né \n z", "q\n" * 5]
    data, at = text.buffers(pa.array(rows))
    start, end, row, number = line_dedup.lines(data, at)
    wanted = [(r, k, x.strip(" \t\n\x0b\x0c\r")) for r, t in enumerate(rows) for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    assert [(r, k, data[a:b].tobytes().decode()) for a, b, r, k in zip(start.tolist(), end.tolist(), row.tolist(), number.tolist(), strict=True)] == wanted
    assert line_dedup.count_lines(data, at).tolist() == [sum(r == k for r, _, _ in wanted) for k in range(len(rows))]


LINES = ["", "a", "short é", "abcdefgh", "the quick brown fox jumps", "naïve café – 東京タワー 🙂🙃 12", "ab" * 30, "é" * 20, "🙂" * 9]


def test_shingles_of_lines():
    """Hashes of a line are equal where its shingles of eight characters are, with characters of any width."""
    rows = [x for x in LINES if x]
    data, at = text.buffers(pa.array(rows))
    hashes, number = line_dedup.shingle_sets(data, at[:-1], at[1:])
    wanted = [[x[k : k + 8] for k in range(max(len(x) - 7, 1))] for x in rows]
    assert number.tolist() == [len(w) for w in wanted]
    flat = [x for w in wanted for x in w]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_pairs_of_lines_are_decided_as_sets():
    """Sorting both sides once gives the decision of the sets, over more pairs than fit one sort."""
    rng = np.random.default_rng(4)
    base = ["".join(map(chr, rng.integers(97, 103, rng.integers(1, 90)))) for _ in range(150)]
    other = [x[: (cut := rng.integers(0, len(x) + 1))] + rng.choice(["", "é", "zz", "🙂"]) + x[cut:] for x in base]
    base, other = base + ["a" * 40, "abcdefgh"], other + ["a" * 90, "abcdefgi"]
    shingles = lambda x: {x[k : k + 8] for k in range(max(len(x) - 7, 1))}
    wanted = [100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b)) for a, b in zip(base, other, strict=True)]
    sides = [[x.encode() for x in side] for side in (base, other)]
    assert line_dedup._similar(*sides, 80).tolist() == wanted == linking._jaccard(line_dedup._unpack)(*sides, 80).tolist()
    assert 20 < sum(wanted) < len(wanted) - 20


def test_extremes_find_as_many_pairs_as_minima():
    """Registers of pairs of a similarity of 0.8 agree at that share, and no more pairs miss all bands than of independent minima."""
    rng = np.random.default_rng(6)
    n, size, own = 4000, 90, 10
    both = rng.integers(0, 1 << 63, (n, size - own), dtype=np.int64)
    sides = [np.concatenate([both, rng.integers(0, 1 << 63, (n, own), dtype=np.int64)], 1) for _ in range(2)]
    found = [line_dedup.extremes(text.mix(x.ravel().astype(np.uint64)), np.full(n, size)) for x in sides]
    equal = (found[0] == found[1]).reshape(n, line_dedup.BANDS, line_dedup.ROWS)
    assert abs(equal.mean() - 0.8) < 0.005
    one = 0.8**line_dedup.ROWS
    missed = (~equal.all(2).any(1)).sum()
    assert missed <= n * (1 - one) ** line_dedup.BANDS + 6


def test_tables_link_as_the_index_does(monkeypatch):
    """Small groups, whose values are counted by a product, come to the components that the index finds."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = int(rng.integers(2, 20))
        seed = rng.integers(0, 1 << 60, (3, 40)).astype(np.uint64)
        sets = [np.unique(np.append(rng.permutation(seed[rng.integers(3)])[: rng.integers(30, 40)], rng.integers(0, 1 << 60, 2).astype(np.uint64))) for _ in range(n)]
        roots = rng.integers(0, n, n)
        parts = []
        for limit in (0, linking.DENSE):
            monkeypatch.setattr(linking, "DENSE", limit)
            label = roots.copy()
            for a, b in linking._forest(np.arange(n), roots, sets, 70):
                label[label == label[b]] = label[a]
            parts.append([np.flatnonzero(label == x).min() for x in label])
        assert parts[0] == parts[1]


def test_shared_buckets(spark, monkeypatch):
    """Buckets of two items or more are found whatever the blocks, and one of all items is dealt out as a few names."""
    monkeypatch.setattr(linking, "NAMES", 4096)
    rng = np.random.default_rng(9)
    rows = [(k, [-1, int(x), int(y)]) for k, (x, y) in enumerate(rng.integers(-(1 << 63), 1 << 63, (3000, 2)))]
    rows += [(3000 + k, [k - 9, rows[k * 7][1][1], rows[k * 7][1][2]]) for k in range(40)]
    seen, twice = set(), set()
    for x in (x for _, names in rows for x in names):
        (twice if x in seen else seen).add(x)
    items = spark.createDataFrame(rows, "id long, buckets array<long>").repartition(5)
    found = [r.bucket for r in linking._shared(items).collect()]
    assert len(found) == len(set(found)) and set(found) == twice
    assert linking._shared(items.limit(0)).count() == 0


def test_codec_cuts_a_block_in_parts(monkeypatch):
    """Texts of a block are cut some at a time, and its pairs entered some at a time, with the same ids."""
    known = parse(vocabulary())
    texts = pa.array(["", "It's  here\n\n", "x" * 70 + " y", "<|endoftext|>a<|endoftext|>", "", "é ü 12 345", "word " * 40])
    whole = [part.tolist() for part in bpe_codec.encode_rows(texts, known)]
    sizes, cut = [], bpe_codec.pretokens
    monkeypatch.setattr(bpe_codec, "pretokens", lambda data, *rest: sizes.append(len(data)) or cut(data, *rest))
    monkeypatch.setattr(bpe_codec, "CUT_BYTES", 20)
    monkeypatch.setattr(bpe_codec, "POSITIONS", 7)
    assert [part.tolist() for part in bpe_codec.encode_rows(texts, known)] == whole
    assert max(sizes) == 200 and len(sizes) > 3
