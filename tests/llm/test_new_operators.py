"""Language identification, ranked search and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkweave.llm import language_id, ranked_search, spelling

FOLDER = "/root/testdata/sf0.01"
CLASHING = "doc_id long, text string, n long, term string, item long, score double, rank int, word string, key string, cell long, root string, x int, lang_pred string, letters int"
EXTRA = (1, "t", 2, 0.5, 3, "w", "k", 4, "r", 5, "p", 6)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], CLASHING).repartition(3)


def ranked(docs, items, k):
    """Every item's best documents, by scoring everything."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    filled = [b for _, b in bags if b]
    n, length = len(filled), sum(sum(b.values()) for b in filled)
    df = Counter(t for b in filled for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in cut(text) if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if absent else doc, -score) for r, (score, absent, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "cells", "item_terms"), [(32, 1 << 24, 1 << 16), (2, 64, 5)])
def test_search_against_scoring_everything(spark, monkeypatch, block, cells, item_terms):
    """Small blocks, shards and sets of items, so that all of them occur, give the same rows."""
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "a", *[f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(8)], "Été", "日本"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(120)]
    docs += [(None, "w1 w2 w3"), (None, None), (7, "w1, w2. W3!"), (7, "w1, w2. W3!"), (200, ""), (201, " .,-"), (202, "w5 " * 5000), (203, "w1 w2 w3"), (204, "w1 w2 w3")]
    items = [(1, "w1 w2 w2 W3 the"), (2, "été 日本 a"), (3, None), (4, "!?"), (5, "unheard of"), (1, "w9 w8"), (None, "w1"), (6, " ".join(f"w{k}" for k in range(60)))]
    found = ranked_search.search(frame(spark, docs), spark.createDataFrame([(*i, 0, 1) for i in items], "item_id long, text string, term int, doc_id int"), 7, item_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == ranked(docs, items, 7)


def test_search_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(docs, items).count() == 1
    assert ranked_search.search(docs.where("false"), items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0
    assert ranked_search.search(docs, items.select("item_id", F.lit(None).cast("string").alias("text"))).count() == 0


def test_bounds_skip_blocks_and_lose_nothing():
    """Blocks are skipped, and what is skipped scores less than what is found."""
    rng = np.random.default_rng(0)
    impacts = np.zeros((2000, 40), np.int32)
    impacts[np.arange(2000), rng.integers(0, 8, 2000)] = 900_000
    impacts[rng.random(impacts.shape) < 0.2] = 300_000
    idf = rng.integers(1, 9000, 40)
    everything = np.arange(40)
    shard = ranked_search.Shard(np.arange(2000), np.zeros(2000, bool), impacts, [everything] * 40, idf)
    scores = impacts.astype(np.int64) @ idf
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    best = shard.search(everything, idf, 20, 1, none)
    want = np.lexsort((np.arange(2000), -scores))[:20]
    assert best[0].tolist() == scores[want].tolist() and best[1].tolist() == want.tolist()
    for term in range(40):
        docs, block, most = shard.blocks(term)
        assert sorted(docs) == np.flatnonzero(impacts[:, term]).tolist()
        assert (most[block] >= impacts[docs]).all() and (most @ idf)[block].min() >= 0
        assert np.array_equal(most, np.stack([impacts[docs[block == b]].max(0) for b in range(len(most))]))
    made = len(shard.made)
    again = ranked_search.Shard(shard.ids, shard.absent, impacts, [everything] * 40, idf)
    again.search(everything, idf, 20, int(scores[want][-1]), none)
    assert len(again.made) <= made


def variants(docs, letters, least, ratio):
    """All words with their near words by all pairs."""
    words = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= letters and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w, n in words.items():
        close = sorted((-words[v], v) for v in words if near(w, v))
        good = bool(close) and -close[0][0] >= ratio * n
        out[w] = (n, len(close), close[0][1] if good else None, -close[0][0] if good else None)

    def root(w):
        return w if out[w][2] is None else root(out[w][2])

    return sorted((w, *v, root(w)) for w, v in out.items())


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(9)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 11))) for _ in range(60)] + ["z" * 90 + "ab", "a" * 40, "ÿÀ×÷éab"]
    words = []
    for s in stems:
        words += [s] * rng.choice([1, 2, 30, 400])
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(s))
            words += [rng.choice([s[:k] + s[k + 1 :], s[:k] + "b" + s[k:], s[:k] + "c" + s[k + 1 :]])] * rng.choice([1, 2, 3, 40])
    words += ["hüttenweg"] * 900 + ["hüttenwege"] * 40 + ["hüttenwegen"] * 3
    rng.shuffle(words)
    docs = [(i, " ".join(w.capitalize() if rng.random() < 0.2 else w for w in words[k : k + 40])) for i, k in enumerate(range(0, len(words), 40))]
    return [*docs, (None, docs[0][1]), (3, docs[1][1]), (3, docs[1][1]), (900, None), (901, ""), (902, "1234 ... under"), (-5, docs[2][1].replace(" ", "-")), (903, "q" * 30000 + " " + "q" * 30000)]


@pytest.mark.parametrize(("group", "chunk", "batch"), [(1 << 13, 1 << 16, 1 << 14), (8, 40, 5)])
def test_spelling_against_all_pairs(spark, monkeypatch, misspelt, group, chunk, batch):
    """Groups cut into parts, small indexes and batches give the same rows."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    monkeypatch.setattr(spelling, "BATCH", batch)
    found = spelling.spelling_variants(frame(spark, misspelt), group=group)
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = variants(misspelt, 7, 2, 10)
    assert sorted(map(tuple, found.collect())) == want
    assert any(r[3] and r[5] != r[3] for r in want)  # some forms have forms


def test_spelling_of_empty_tables(spark):
    assert spelling.spelling_variants(frame(spark, [(1, "too short"), (2, None)])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, "x")]).where("false")).count() == 0
    assert [tuple(r) for r in spelling.spelling_variants(frame(spark, [(1, "lonelyword lonelyword")])).collect()] in ([("lonelyword", 2, 0, None, None, "lonelyword")], [])


def test_index_finds_every_near_word():
    rng = random.Random(1)
    for _ in range(20):
        letters = "abé"[: rng.choice([2, 3])]
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, rng.choice([9, 12, 20])))) for _ in range(250)}
        words = sorted(words)
        number = {w: i for i, w in enumerate(words)}
        want = set()
        for w, i in number.items():
            close = {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in ("", *letters)}
            want |= {(i, number[v]) for v in close - {w} if v in number}
        column = pa.array([w.encode("latin-1") for w in words], pa.binary())
        found = [p for half in (True, False) for p in zip(*(x.tolist() for x in spelling._found(column, None, column, half)), strict=True)]
        assert len(found) == len(set(found)) and set(found) == want


def test_crc32_of_spans():
    data = np.frombuffer(("abcé" * 40).encode(), np.uint8)
    start, end = np.array([0, 3, 5, 10]), np.array([0, 9, 6, 190])
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in (1, -7, 12345678901, 0)], np.int64)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before, strict=True)]
    assert spelling.crc32(data, start, end, before).tolist() == want


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.train(docs)
    rows = docs.select("doc_id", "lang").join(language_id.languages(docs, model), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert sum(r.rejected for r in held) <= 0.1 * len(held)
    # learned from the training fold only: other labels of the held-out fold change nothing
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    again = language_id.train(other)
    assert again.languages == model.languages and np.array_equal(again.embeddings, model.embeddings)


def test_language_of_odd_rows(spark):
    learnt = [(i, f"{'the cat and the dog' if i % 2 else 'le chat et le chien'} {i}") for i in range(60)]
    odd = [(100, None), (101, ""), (102, "12 34 !?"), (103, "é"), (None, "the dog"), (104, "the cat " * 20000), (104, "the cat " * 20000), (105, "日本"), (None, None)]
    docs = frame(spark, [*learnt, *odd])
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") < 60, F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr")))
    model = language_id.train(labelled)
    got = {}
    for r in language_id.languages(docs, model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out, 0 <= r.score <= 1, r.rejected))
    assert [got[i][0][0] for i in (100, 101, 102)] == ["und"] * 3 and all(got[i][0][3] for i in (100, 101, 102))
    assert {x[0] for x in got[103] + got[105]} <= {"en", "fr"}
    assert [x[0] for x in got[104]] == ["en", "en"] and sorted(x[0] for x in got[None]) == ["en", "und"] and not any(x[1] for x in got[None])
    assert all(got[i][0][0] == ("en" if i % 2 else "fr") for i in range(60))
    none = language_id.train(labelled.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in language_id.languages(docs, none).collect()} == {("und", 0.0)}
    assert language_id.languages(docs.where("false"), model).count() == 0


def test_averages_are_those_of_a_loop():
    texts = ["Ab, c", "", "éa  b", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    row, bucket = language_id.grams(data, at)
    for i, text in enumerate(texts):
        raw = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 97 <= b < 123 else 32 for b in f" {text} ".encode()) if text else b" "
        want = sorted(
            int(language_id.T.mix(np.array([int.from_bytes(raw[k : k + n], "big") + ((n - 1) << 40)], np.uint64))[0] >> np.uint64(64 - language_id.BITS))
            for n in language_id.ORDERS for k in range(len(raw) - n + 1) if raw[k : k + 2] != b"  "
        )
        if text:
            assert sorted(bucket[row == i].tolist()) == want
    many = language_id.Model([f"l{k:02d}" for k in range(20)], np.random.default_rng(0).normal(size=(1 << language_id.BITS, language_id.DIMS)), np.random.default_rng(1).normal(size=(language_id.DIMS, 20)), np.zeros(20))
    wide = many.embeddings @ many.output
    got = np.log(many.probabilities(language_id.averages(many.table(), row, bucket, 4)))
    direct = language_id.averages(wide, row, bucket, 4)
    assert np.allclose(got - got[:, :1], direct - direct[:, :1])
