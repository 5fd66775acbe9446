"""The numbered operators against brute force, the public libraries and held-out labels."""

import functools
import hashlib
import html
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from talkweave.llm import bpe_codec, decontaminate, embedding_links, line_dedup, main_text, minhash_dedup, ppm_scores, quality, token_counts, toxicity
from talkweave.llm.queries import vocabulary
from talkweave.llm.vocabulary import parse

DOCS = "doc_id long, text string, source string, score double, n_lines int, component_id long"
WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    """Families of near copies around originals, chains, exact copies, odd texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(2, 6)))
    out = [None, "", " \n\t", "One two", "one TWO", "x " * 3000, "日本 語 " * 30, "tail"]
    for size in (40, 90, 200):
        base = [word() for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                copy[rng.randrange(size)] = word()
            out.append(" ".join(copy).replace(" ", "\n", 2) if rng.random() < 0.5 else " ".join(copy))
        chain = list(base)
        for _ in range(8):
            for _ in range(max(1, size // 60)):
                chain[rng.randrange(size)] = word()
            out += [" ".join(chain)] * rng.choice([1, 2])
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "s", 0.0, 1, 7) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_minhash_against_all_pairs(docs, texts):
    sets = {}
    for i, t in texts:
        w = spaced(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = components(sets, links)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), roots[i], roots[i] == i) for i in sets}
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns


def test_minhash_empty_and_null_ids(spark, docs):
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    words = [f"w{k}" for k in range(100)]
    near, other = " ".join(words), " ".join([*words[:-1], "x"])
    rows = [(None, near), (9, other), (3, near.upper()), (3, "unlike all others here"), (5, "unlike all others here"), (None, "alone a b c d e")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted([(None, 3, False), (9, 3, False), (3, 3, True), (3, 3, True), (5, 3, False), (None, None, False)], key=repr)
    odd = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(odd).collect()) == [(-1, 4, False), (2, 2, True), (4, 4, True), (4, 4, True)]


def test_filters_decide_by_row(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (4, text("c")), (4, text("c")), (4, text("d")), (None, text("c")), (7, text("e"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = lambda found: sorted(map(tuple, found), key=repr)
    assert order(minhash_dedup.keep_one(frame).collect()) == order([rows[0], rows[1], rows[3], rows[5], rows[7]])
    bench = spark.createDataFrame([(1, text("a")), (2, text("d"))], "item_id long, text string")
    assert order(decontaminate.clean(frame, bench).collect()) == order([r for r in rows if r[1] not in (text("a"), text("d"))])
    learnt = [(100 + k, ("vile " if k % 2 else "kind ") + f"w{k}") for k in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in learnt], "doc_id long, toxic int")
    given = [*learnt, (None, "vile x"), (None, "kind x"), (5, "vile y"), (5, "kind y")]
    kept = toxicity.without_toxic(spark.createDataFrame(given, "doc_id long, text string"), labels)
    assert order(kept.collect()) == order([r for r in given if r[1].startswith("kind")])


def thue_morse(n):
    """A word and its complement that collide in every polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_do_not_collide(spark):
    x, y = thue_morse(2048)
    spaces = x.translate(str.maketrans("ab", " a")), y.translate(str.maketrans("ab", " a"))
    rows = [(1, f"{x} one"), (2, f"{y} one"), (3, f"{spaces[0]} z"), (4, f"{spaces[1]} z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    pair = frame.where("doc_id < 3")
    assert sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(pair).collect()) == [(1, 1), (2, 2)]
    assert minhash_dedup.keep_one(pair).count() == 2
    # the lines have the same eight-letter shingles, so they are equal sets, but the counts of words differ
    known = spark.createDataFrame([(1, f"{x} {x}"), (2, f"{y}")], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm_scores.scores(known).collect()}
    assert [(got[i].n_tokens, got[i].n_known) for i in (1, 2)] == [(3, 3), (2, 2 if zlib.crc32(b"2") % 10 else 1)]
    lines = spark.createDataFrame([(1, f"{'q' * 40}{x}{'r' * 40}"), (2, f"{'s' * 2100}{y}{'t' * 2100}")], "doc_id long, text string")
    assert sum(r.n_removed for r in line_dedup.keep_lines(lines).collect()) == 0
    from talkweave.llm import text as T

    data = np.frombuffer((x + y).encode(), np.uint8)
    a, b = T.Spans(data).hash(np.array([0, 2048]), np.array([2048, 4096]))
    assert a != b


def test_helper_names_as_columns(spark):
    """Columns with any name an operator might use inside are carried unchanged."""
    names = ["stays", "_stays", "_STAYS_", "_doc", "_text", "_d", "_t", "_name", "_hashed", "_removed", "_key", "_hash", "n", "root", "w", "kept", "score", "held_out", "n_words", "items", "ids"]
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(i, text(i % 4), *[f"{c}{i}" for c in names]) for i in range(8)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    bench = spark.createDataFrame([(1, text(3))], "item_id long, text string")
    assert sorted(map(tuple, minhash_dedup.keep_one(frame).collect())) == rows[:4]
    assert sorted(map(tuple, decontaminate.clean(frame, bench).collect())) == [r for r in rows if r[0] % 4 != 3]
    kept = line_dedup.keep_lines(frame)
    assert kept.columns == [*frame.columns, "n_lines", "n_removed"]
    assert sorted((*r[:2], *r[2:-2], r.n_removed) for r in kept.collect()) == [(i, t if i < 4 else "", *rest, int(i >= 4)) for i, t, *rest in rows]
    assert toxicity.without_toxic(frame, frame.select("doc_id", F.lit(0).alias("toxic"))).columns == frame.columns


def test_register_estimates():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.3, 0.6, 0.85, 0.95):
        both = rng.integers(0, 1 << 63, int(1000 * share), dtype=np.int64).astype(np.uint64) * np.uint64(2)
        rest = int(1000 * (1 - share) / 2)
        sets = [np.concatenate([both, rng.integers(0, 1 << 63, rest, dtype=np.int64).astype(np.uint64) * np.uint64(2)]) for _ in range(2)]
        sig = minhash_dedup.registers(np.concatenate(sets), np.array([len(s) for s in sets]))
        n = np.array([float(len(sets[0]))])
        errors.append(abs(minhash_dedup.similarity(n, n, sig[:1], sig[1:])[0] - len(both) / (len(both) + 2 * rest)))
    assert max(errors) < 0.2


def test_lines_against_all_pairs(docs, texts):
    lines = [(i, k, x.strip(WHITE)) for i, t in texts for k, x in enumerate((t or "").split("\n")) if x.strip(WHITE)]
    keys = list(dict.fromkeys(x for _, _, x in lines))
    sets = [frozenset(x[k : k + 8] for k in range(max(len(x) - 7, 1))) for x in keys]
    links = [(a, b) for a in range(len(keys)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = components(range(len(keys)), links)
    number, seen, gone = {x: i for i, x in enumerate(keys)}, set(), defaultdict(set)
    for i, k, x in lines:
        if roots[number[x]] in seen:
            gone[i].add(k)
        seen.add(roots[number[x]])
    expected = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts}
    got = line_dedup.keep_lines(docs)
    assert {r.doc_id: r.text for r in got.collect()} == expected
    assert set(docs.columns) <= set(got.columns)
    assert line_dedup.keep_lines(docs.limit(0)).count() == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows = [base[i % 6] + rng.normal(scale=0.25, size=8) for i in range(80)]
    rows += [rows[0], rows[0], rows[0] * 3, np.zeros(8)]
    vectors = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)] + [(200, None), (201, [float("nan")] * 8), (202, [1.0, None] * 4), (203, []), (204, [1.0, 0.0])]
    got = {r.vec_id: r for r in embedding_links.near_links(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()}
    good = {i: np.array(v) for i, v in vectors if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] / math.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9]
    roots = components([i for i, _ in vectors], links)
    degree = Counter(i for link in links for i in link)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (degree[i], roots[i], roots[i] == i) for i, _ in vectors}
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert embedding_links.near_links(none).first().n_links == 0 and embedding_links.near_links(none.limit(0)).count() == 0


def test_embeddings_with_null_and_repeated_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.01, 1.0]), (None, [1.0, 0.02]), (None, [-1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (1, [3.0])]
    got = embedding_links.near_links(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, n_links int")).collect()
    expected = [(5, 2, 5, True), (5, 1, 5, True), (6, 2, 5, False), (7, 1, 5, False), (None, 2, 5, False), (None, 0, None, False), (8, 1, 2, False), (2, 1, 2, True), (1, 0, 1, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_embeddings_of_one_large_group(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.array([1.0, 0, 0, 0]) + rng.normal(scale=0.01, size=4)]) for i in range(9000)]
    got = embedding_links.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(8999, 0, 9000)]


def test_ppm_against_brute_force(spark, docs, texts):
    tokens = {i: [*spaced(t), None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    known = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(known.values()), len(known)
    order = ppm_scores.ORDER
    start = b"\n" * order
    coded = {i: start + " ".join(tokens[i][:-1]).encode() + b"\n" for i in tokens}
    trie = [{} for _ in range(order + 1)]
    for i, t in coded.items():
        if not held[i]:
            for p in range(order, len(t)):
                for k in range(order + 1):
                    trie[k].setdefault(t[p - k : p], Counter())[t[p]] += 1

    @functools.cache
    def code(context, symbol):
        out, seen = 0.0, set()
        for k in range(order, -1, -1):
            left = {s: c for s, c in trie[k].get(context[order - k :], {}).items() if s not in seen}
            if left:
                total = 2 * sum(left.values())
                if symbol in left:
                    return out + math.log10((2 * left[symbol] - 1) / total)
                out += math.log10(len(left) / total)
                seen |= set(left)
        return out - math.log10(256 - len(seen))

    for r in ppm_scores.scores(docs).collect():
        words, t = tokens[r.doc_id], coded[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(known[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert r.score == pytest.approx(sum(code(t[p - order : p], t[p]) for p in range(order, len(t))), rel=1e-9)
    assert ppm_scores.scores(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER.replace("sf0.001", "sf0.1")), reason="no tables")
def test_ppm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(FOLDER.replace("sf0.001", "sf0.1") + "/documents.parquet")
    score, base = ppm_scores.scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.97 * base


def test_ppm_odd_rows(spark):
    long = "the cat sat on the mat " * 60_000
    rows = [(1, long), (1, long), (None, "the cat"), (2, None), (3, ""), (4, " \n"), (5, "zebra\tquilt")]
    got = ppm_scores.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 360_001), (1, 360_001), (2, 1), (3, 1), (4, 1), (5, 3)]
    assert not any(r.held_out for r in got if r.doc_id is None) and len({r.score for r in got if r.n_tokens == 1}) == 1
    untrained = ppm_scores.scores(spark.createDataFrame([(None, "ab"), (None, "")], "doc_id long, text string")).collect()
    assert sorted(r.score for r in untrained) == pytest.approx([-3 * math.log10(256), -math.log10(256)]) and {r.n_known for r in untrained} == {0}


def test_grams_sum_to_one():
    text = ppm_scores.stream(np.frombuffer(b"ab c abdab cab c", np.uint8), np.array([0, 8, 16]))
    assert text.tobytes() == b"ab c abd\nab cab c\n"
    gram = np.concatenate([g for g, _ in ppm_scores.gram_slices(text)]).astype(np.int64)
    assert gram[0] == int.from_bytes(b"\n\n\n\n\na", "big") and gram[12] == int.from_bytes(b"\n\nab c", "big")
    pairs = np.zeros((256, 256))
    np.add.at(pairs, ((gram >> 8) & 255, gram & 255), 1)
    context = int.from_bytes(b" c ab", "big")
    asked = np.unique(np.concatenate([gram[(gram >> 8 & 0xFFFF) == context & 0xFFFF], (context << 8) + np.arange(256)]))
    count = np.array([(gram == g).sum() for g in asked], float)
    p = 10 ** ppm_scores.log_probabilities(asked, count, pairs)[(asked >> 8) == context]
    assert len(p) == 256 and p.sum() == pytest.approx(1)


ODD = ["", "don't we'll 've ''t 're 'tis  x \n\n a  b  \t\n", "<|endoftext|> a <|endoftext|><|endoftext|>b<|endoftext", "  lead", "trail   ", "a" * 300, "日本語 ٣٤ ½　y", "\x1c a\x85b​c﻿d", "é 😀 😀's", "'re", "=" * 200, " " * 50 + "x", "Ab" * 500]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_str(vocabulary().decode())


def strange():
    rng = random.Random(2)
    letters = [*map(chr, range(0x20, 0x7F)), *"éßñ日本\n\t　'", "th", "ing", " "]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300)]


def test_codec_and_counts_against_library(spark, library, texts):
    every = [*ODD, *strange(), *(t for _, t in texts if t)]
    rows = spark.createDataFrame([*enumerate(every), (9999, None)], "doc_id long, text string")
    expected = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(every)} | {9999: []}
    content = vocabulary()
    decoded = bpe_codec.decode(bpe_codec.encode(rows, content), content)
    for r in decoded.collect():
        assert r.ids == expected[r.doc_id] and r.decoded == (r.text or "") == library.decode(r.ids, skip_special_tokens=False)
    for r in bpe_codec.round_trip(rows, content).collect():
        text = every[r.doc_id] if r.doc_id < 9999 else ""
        assert r.asDict() == {"doc_id": r.doc_id, "n_tokens": len(expected[r.doc_id]), "ids_sha256": hashlib.sha256(",".join(map(str, expected[r.doc_id])).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}
    for r in token_counts.token_counts(rows, content).collect():
        text = every[r.doc_id] if r.doc_id < 9999 else ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(expected[r.doc_id]), len(expected[r.doc_id]) > 1024)
    assert token_counts.token_counts(rows.limit(0), content).count() == 0


def test_decode_keeps_invalid_bytes_visible():
    v = parse(vocabulary())
    assert bpe_codec.decode_ids(np.array([int(v.byte_id[0xE9])]), v).decode("utf-8", "replace") == "�"


def test_long_pieces_against_library(library, monkeypatch):
    rng = random.Random(8)
    drawn = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    n = 6000
    long = ["a" * n, "ab" * n, "=" * n, " " * n, "日本語中文" * n, drawn("abcdefghijklmnopqrstuvwxyz", n), drawn(["th", "ing", "er"], n), drawn("=-_*#", n), drawn("éßñж日", n), "." * n + "x " + "." * 97]
    machine = token_counts.Transducer(parse(vocabulary()))
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in long]
    assert token_counts.count_rows(pa.array(long), machine).tolist() == expected
    for size in (1, 7, 5000):  # the cut of pieces into chunks must not matter
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert token_counts.count_rows(pa.array([t[:700] for t in long]), machine).tolist() == [len(library.encode(t[:700], add_special_tokens=False).ids) for t in long]


def test_transducer_is_dropped_and_rebuilt(monkeypatch):
    machine = token_counts.Transducer(parse(vocabulary()))
    first = token_counts.count_rows(pa.array(strange()), machine)
    monkeypatch.setattr(token_counts, "MOST_STATES", 10)
    assert (token_counts.count_rows(pa.array(strange()), machine) == first).all()


def test_decontaminate_against_windows(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdef") + rng.choice(["", "É", "9"]) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (10, "Tiny É item!"), (11, None), (12, " .. "), (None, text(15)), (2, text(10))]
    docs = [(0, None), (1, ""), (2, items[0][1].upper().replace("É", "é")), (3, text(5) + " -- " + items[0][1][:60]), (4, "so tiny, É... ITEM; and"), (5, items[5][1]), (6, text(400)), (6, items[1][1]), (None, items[1][1]), (7, " ".join([items[1][1]] * 40))]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for i, t in items:
        w = word.findall(lower(t))
        n = min(len(w), 10)
        windows += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if w else []
    expected = []
    for i, t in docs:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= {str(item)} - {"None"}
        expected.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in decontaminate.contamination(*frames).collect()) == order(expected)
    few, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, 0
    try:
        assert order(tuple(r) for r in decontaminate.contamination(*frames).collect()) == order(expected)
    finally:
        decontaminate.BROADCAST_ROWS = few
    assert decontaminate.contamination(frames[0], frames[1].limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(frames[0].limit(0), frames[1]).count() == 0


PAGE = '<!doctype html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>menu</ul></nav><div class="ad">buy</div>'


def test_main_text(spark):
    article = "<article><h1>T &amp; U</h1><p><b>one\n  two<br>three<p>fo<i>u</i>r &lt;x&gt;</p><div id='comments'><div>c</div>d</div><form>f</form><p class=\"notice\">n<p>last &copy &am</article>"
    rows = [(0, "http://h/a", PAGE + article + "<footer>foot</footer>"), (1, None, None), (2, "http://h/b", ""), (3, "http://h/c", "plain <b>text"), (4, "http://h/d", PAGE + article)]
    shared = "<p>all rights reserved by the good people of this fine place</p>"
    rows += [(10 + k, "http://Host.example:80/x", f"<body>{shared}<p>own words of page {k} that no other page of this host has {k}</p>") for k in range(3)]
    got = {r.page_id: (r.text, r.n_chars) for r in main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "T & U\none two three\nfour <x>\nlast © &am"
    assert got[0] == got[4] == (text, len(text))
    assert got[1] == got[2] == ("", 0) and got[3] == ("plain text", 10)
    assert got[11][0] == "own words of page 1 that no other page of this host has 1"
    assert html.unescape("&copy") == "©"


ARTICLE = "<p>" + "long text of the article goes here. " * 8 + "</p>"


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        (f'<div class="layout no-sidebar">{ARTICLE}</div>', 1),
        (f'<div class="content has-menu">{ARTICLE}</div>', 1),
        (f'<form id="aspnetForm"><div class="nav">menu</div><article>{ARTICLE}</article></form>', 1),
        (f'<form><div>{ARTICLE}</div></form><div class="sidebar">gone</div>', 1),
        (f'<article>{ARTICLE}<div class="social-science">b</div><p class="related-work">c</p></article>', 3),
        (f'<div class="page-content widget">{ARTICLE}</div><div class="post-list related-posts">gone</div>', 1),
        (f'<article>{ARTICLE}</article><div class="comments"><article>gone {ARTICLE * 9}</article></div>', 1),
        (f'<article>{ARTICLE}<div class="site-header">gone</div><div id="cookie_banner">gone</div><form>gone</form></article>', 1),
        (f'<nav>{ARTICLE}</nav><p>short</p>', 1),
        ('<div class="sidebar"><div class="menu">one two three</div></div>', 1),
    ],
)
def test_names_that_hold_the_page_are_not_believed(page, kept):
    found = main_text.blocks(page)
    assert len(found) == kept and not any("gone" in t for _, t in found)


def test_main_text_keeps_copies_on_a_host(spark):
    words = lambda name, n=30: " ".join(f"{name}{k}" for k in range(n))
    page = lambda *blocks: "<body>" + "".join(f"<div class=content>{b}</div>" for b in blocks) + "</body>"
    url, other, third, mixed = "http://two/x", "http://near/x", "http://heading/x", "http://mixed/x"
    pages = [(1, url, page(words("a"))), (2, url, page(words("a")))]
    pages += [(10 + k, other, page(words("b").replace("b29", f"v{k}"))) for k in range(4)]
    pages += [(20 + k, third, page("The plan" if k < 2 else f"Plan {k}", words(f"c{k}x"))) for k in range(6)]
    pages += [(30 + k, mixed, page(words("footer", 9), words("d" if k < 4 else f"d{k}x"))) for k in range(8)] + [(None, mixed, page(words("footer", 9), words("e")))]
    got = {r.page_id: r.text for r in main_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == words("a")
    assert [got[10 + k] for k in range(4)] == [words("b").replace("b29", f"v{k}") for k in range(4)]
    assert [got[20 + k].split("\n")[0] for k in range(6)] == ["The plan"] * 2 + [f"Plan {k}" for k in range(2, 6)]
    assert [got[30 + k] for k in range(8)] == [words("d")] * 4 + [words(f"d{k}x") for k in range(4, 8)] and got[None] == words("e")


def test_main_text_odd_pages(spark):
    schema = "page_id long, url string, html string, text long, n_chars string"
    words = " ".join(f"w{k}" for k in range(200_000))
    pages = [(1, "http://a", f"<article>{words}</article>"), (2, "http://a", "<a " + '"' * 3000), (3, None, "<p title=it's>x</p>" + "<b =\"" * 2000), (4, "http://a", "<article>x<b <c>y</article>"), (4, "http://a", "<article>x<b <c>y</article>"), (None, None, None)]
    frame = spark.createDataFrame([(*p, 7, "q") for p in pages], schema)
    begin = time.perf_counter()
    got = sorted(((r.page_id or 0, r.text) for r in main_text.main_texts(frame).collect()), key=repr)
    assert time.perf_counter() - begin < 60
    assert got[0] == (0, "") and got[1] == (1, words) and got[4] == got[5] == (4, "xy")
    assert dict(got)[3].startswith("x")
    assert main_text.main_texts(frame.limit(0)).count() == 0


def test_unique_blocks_against_all_substrings():
    rng = random.Random(7)
    for _ in range(200):
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(4)]
        heads = [x.tolist() for x in main_text._hashes(texts)]
        runs = {tuple(t.split()[k : k + 5]) for t in texts for k in range(max(1, len(t.split()) - 4))}
        chosen = {r for r in runs if rng.random() < 0.4}
        names = {h: r for t, own in zip(texts, heads) for h, r in zip(own, [tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))])}
        kept = []
        for t in texts:
            w = t.split()
            covered = {p for k in range(len(w)) for r in chosen if tuple(w[k : k + len(r)]) == r and (len(r) == 5 or len(r) == len(w)) for p in range(k, k + len(r))}
            if len(covered) < main_text.COVERED * len(w):
                kept.append(t)
        assert main_text.unique_blocks(texts, heads, {h for h, r in names.items() if r in chosen}) == (kept or texts)


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    return read("documents"), read("labels")


def test_classifiers_on_held_out_rows(tables):
    docs, labels = tables
    for module, label, least in ((toxicity, "toxic", 0.9), (quality, "quality", 0.9)):
        score = getattr(module, label if label == "quality" else "toxicity")
        rows = score(docs, module.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
        assert (rows["predicted"] == rows[label]).mean() >= least
        assert rows["score"].between(0, 1).all()


def test_toxicity_recall_on_held_out_rows(tables):
    docs, labels = tables
    rows = toxicity.toxicity(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = rows[rows["toxic"] == 1], rows[rows["toxic"] == 0]
    assert len(toxic) >= 5 and toxic["predicted"].mean() >= 0.5 and clean["predicted"].mean() <= 0.05


def test_toxicity_on_the_large_held_out_rows(spark):
    read = lambda name: spark.read.parquet(FOLDER.replace("sf0.001", "sf0.1") + f"/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    rows = toxicity.toxicity(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert rows[rows["toxic"] == 1]["predicted"].mean() >= 0.8 and rows[rows["toxic"] == 0]["predicted"].mean() <= 0.02
    rows = quality.quality(docs, quality.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert rows[rows["quality"] == 1]["predicted"].mean() >= 0.8 and rows[rows["quality"] == 0]["predicted"].mean() <= 0.2


def test_logits_against_all_pairs():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=50), rng.normal(size=(50, 4))
    sets = [np.sort(rng.choice(50, size=n, replace=False)) for n in (1, 2, 9, 0, 30)]
    got = toxicity.Model(-0.3, w, v).logits(np.concatenate(sets), np.array([len(s) for s in sets]))
    expected = [-0.3 + w[s].sum() + sum(v[a] @ v[b] for k, a in enumerate(s) for b in s[k + 1 :]) / max(len(s), 1) for s in sets]
    assert got == pytest.approx(expected)


def test_votes_against_a_loop():
    rng = np.random.default_rng(1)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = unit(rng.normal(size=(60, 6)))
    vectors[20:40] = vectors[0]  # ties beyond the border
    labels, asked = rng.integers(0, 2, 60).astype(float), unit(np.concatenate([rng.normal(size=(30, 6)), vectors[:1]]))
    got = quality.Model(None, None, vectors, labels).scores(asked)
    for x, score in zip(asked, got, strict=True):
        cosine = vectors @ x
        near = sorted(range(60), key=lambda i: (-cosine[i], i))[: quality.NEIGHBOURS]
        weight = [max(float(cosine[i]), 1e-6) ** quality.POWER for i in near]
        assert score == pytest.approx(sum(a * labels[i] for a, i in zip(weight, near, strict=True)) / sum(weight), rel=1e-4)


@pytest.mark.parametrize("strict", [False, True])
def test_toxicity_learns_a_pair_neutral_alone(strict):
    """Terms 1 and 2 are toxic together, clean alone; the rest is toxic, by term 3 unless strict. Each alone is toxic in half its rows, like all rows."""

    def rows(seed):
        rng, sets, labels = np.random.default_rng(seed), [], []
        for k in range(2400):
            own = [[1, 2], [1], [2], [] if strict else [3]][k % 4]
            sets.append(sorted({*own, *rng.integers(1000, 1400, 12).tolist()}))
            labels.append(float(k % 4 in (0, 3)))
        return np.concatenate(sets).astype(np.int64), np.array([len(x) for x in sets]), np.array(labels)

    model = toxicity.fit(*rows(0))
    terms, number, labels = rows(1)
    toxic = model.logits(terms, number) >= 0
    assert model.factors[1].any() and model.factors[2].any()
    assert toxic[0::4].mean() >= 0.8 and toxic[1::4].mean() <= 0.1 and toxic[2::4].mean() <= 0.1


def test_classifiers_without_labels_or_text(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100000), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, toxic int, quality int")
    for model, score in ((toxicity.train(odd, labels), toxicity.toxicity), (quality.train(odd, labels), quality.quality)):
        rows = score(odd, model).collect()
        assert len({r.score for r in rows}) == 1 and all(r.predicted == (r.score >= (0.5 if score is toxicity.toxicity else 0.3)) for r in rows)
        assert score(odd.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1)], "doc_id long, toxic int, quality int")
    assert quality.quality(odd, quality.train(odd, one)).count() == 4 and toxicity.toxicity(odd, toxicity.train(odd, one)).count() == 4


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{folder}/documents.parquet")
    frame = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == before.columns, name
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert 0 < len(rows) < before.count() and all(r.round_trip for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[k : k + 10]) for w in (word.findall(lower(t)) for t in bench) for k in range(len(w) - 9)}
    for r in rows:
        w = word.findall(lower(r.text))
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
    assert F is not None


def test_pipeline_against_brute_force(spark, library, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    given = [(100 + k, ("vile " if k % 4 == 1 else "kind ") + words(25)) for k in range(240)]
    own = [t for _, t in given]
    broken = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    item = words(40)
    shared = words(20)
    given += [(1, None), (2, ""), (3, " \n\t"), (None, "kind " + words(30))]
    given += [(400 + k, f"kind {words(20)}\n{shared[:-k] if k else shared}") for k in range(4)]  # one line in four spellings
    given += [(500 + k, broken(own[4 * k], 7)) for k in range(5)]  # copies whose lines are cut elsewhere
    given += [(510, "  " + own[0] + " \n" + own[2]), (511, f"kind\t{words(3)}\n" * 3)]  # lines that stand elsewhere, a line three times
    given += [(600 + k, f"kind {words(15)}\n{words(4)} {' '.join(item.split()[3 * k : 3 * k + 9 + k % 2])} {words(4)}") for k in range(6)]  # nine words of an item, or ten
    rng.shuffle(given)
    folder = str(tmp_path)
    rows = [(i, t, "en", "web", len(t or "")) for i, t in given]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int((t or "").startswith("vile"))) for i, t in given if i is not None], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = sorted((r for r in given if not (r[1] or "").startswith("vile")), key=lambda r: -1 if r[0] is None else r[0])
    # lines: the first of each component stays
    lines = [(n, k, x.strip(WHITE)) for n, (_, t) in enumerate(left) for k, x in enumerate((t or "").split("\n")) if x.strip(WHITE)]
    keys = list(dict.fromkeys(x for _, _, x in lines))
    sets = [frozenset(x[k : k + 8] for k in range(max(len(x) - 7, 1))) for x in keys]
    roots = components(range(len(keys)), [(a, b) for a in range(len(keys)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    seen, gone, had = set(), defaultdict(set), defaultdict(int)
    for n, k, x in lines:
        root = roots[keys.index(x)]
        had[n] += 1
        if root in seen:
            gone[n].add(k)
        seen.add(root)
    kept = [(i, t if not gone[n] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[n])) for n, (i, t) in enumerate(left) if not had[n] or len(gone[n]) < had[n]]
    assert len(kept) < len(left) and any(gone[n] and len(gone[n]) < had[n] for n in range(len(left)))
    # near-duplicates: the smallest doc_id of each component stays
    grams = [frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if (w := spaced(t)) else frozenset() for _, t in kept]
    links = [(a, b) for a in range(len(kept)) for b in range(a) if grams[a] and grams[b] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    roots = components(range(len(kept)), links)
    assert len(links) >= 4
    kept = [r for n, r in enumerate(kept) if roots[n] == n]
    # benchmark: a shared window of ten words
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tens = lambda t: {tuple(w[k : k + 10]) for w in [word.findall(lower(t))] for k in range(len(w) - 9)}
    expected = [r for r in kept if not tens(r[1]) & tens(item)]
    assert len(kept) - len(expected) == 3
    got = corpus_pipeline.run(spark, folder).collect()
    order = lambda found: sorted(found, key=repr)
    assert order((r.doc_id, r.text, r.source, r.n_chars) for r in got) == order((i, t, "web", None if t is None else len(t)) for i, t in expected)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.round_trip
