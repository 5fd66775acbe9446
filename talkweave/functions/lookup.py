"""Large word tables against texts: which entry of a table occurs, and phrases replaced by a table.

A table is compiled once on the driver to arrays (a trie) or an automaton and broadcast
where its size is checked; texts pass in Arrow batches, in one scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import text as X

#: Characters of entries that one automaton or trie may hold; larger tables are taken in parts, each a scan.
CHARACTERS = 4 << 20
#: Characters of text that are looked at together.
PIECE = 1 << 18


def _parts(entries: DataFrame, entry: str) -> list[DataFrame]:
    """The table in parts of about CHARACTERS characters, by hash."""
    size = entries.agg(F.coalesce(F.sum(F.length(entry) + 1), F.lit(0))).first()[0]
    number = -(-size // CHARACTERS)
    return [entries.where(F.pmod(F.xxhash64(entry), F.lit(number)) == k) for k in range(number)]


def _first_entry(text: Column, automaton: ahocorasick.Automaton, places: list[int], entries: list[str], spark: SparkSession) -> Column:
    """The entry of least place among those that the text contains: struct (pos, entry), or null."""
    shared = spark.sparkContext.broadcast((automaton, places, entries))

    @F.pandas_udf("struct<pos:long,entry:string>")
    def first(texts: pd.Series) -> pd.DataFrame:
        known, places, entries = shared.value
        found = [None if t is None else min((i for _, i in known.iter(t)), default=None) for t in texts]
        return pd.DataFrame({"pos": pd.array([None if i is None else places[i] for i in found], "Int64"), "entry": [None if i is None else entries[i] for i in found]})

    return X.bound(first(text), lambda found: F.when(found["pos"].isNotNull(), found))


def denied_by(rows: DataFrame, column: str, entries: DataFrame, name: str = "denied_by") -> DataFrame:
    """The rows with ``name``: the first entry that the column's text contains, by pos, or null.

    entries: entry, pos long (unique).  Case is ignored; blank entries, and null ones, deny nothing.
    An automaton over all entries (Aho and Corasick, 1975) reads every text once, however
    many entries there are; of a table beyond CHARACTERS each part has one.
    """
    wanted = entries.where(X.ustrip("entry") != "").groupBy(F.lower("entry").alias("key")).agg(F.min("pos").alias("pos"), F.min_by("entry", "pos").alias("entry"))
    hits = []
    for part in _parts(wanted, "key"):
        automaton, places, texts = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], []
        for row in part.orderBy("pos").toLocalIterator():
            automaton.add_word(row.key, len(places))
            places.append(row.pos)
            texts.append(row.entry)
        automaton.make_automaton()
        hits.append(_first_entry(F.lower(column), automaton, places, texts, rows.sparkSession))
    if not hits:
        return rows.withColumn(name, F.lit(None).cast("string"))
    return rows.withColumn(name, F.array_min(F.array(*hits))["entry"] if len(hits) > 1 else hits[0]["entry"])


@dataclass
class Trie:
    """Phrases as nodes and their children in order of (node, letter); letters are numbered by use."""

    codes: np.ndarray  # by code point: the letter, or 0
    root: np.ndarray  # by letter: the root's child, or 0
    keys: np.ndarray  # node * letters + letter of every other child, ascending; never empty
    children: np.ndarray  # of these keys
    ends: np.ndarray  # by node: the phrase that ends there, or -1
    replacements: list[str]
    depth: int  # letters of the longest phrase

    def longest(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, phrase) of the longest phrase at each place of the code points where there is one."""
        found = [self._longest(text[k : k + PIECE + self.depth], PIECE) for k in range(0, len(text), PIECE)]
        place = np.concatenate([np.zeros(0, np.int64), *[f[0] + k * PIECE for k, f in enumerate(found)]])
        return place, *(np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (1, 2))

    def _longest(self, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the first ``most`` places: all step from letter to letter together, until no phrase goes on."""
        codes = self.codes[np.minimum(text, len(self.codes) - 1)]
        place = np.flatnonzero(self.root[codes[:most]])
        node = self.root[codes[place]]
        letters, depth = len(self.root), 1
        length, phrase = np.zeros(len(codes), np.int64), np.full(len(codes), -1, np.int64)
        while len(place):
            ends = self.ends[node] >= 0
            length[place[ends]], phrase[place[ends]] = depth, self.ends[node[ends]]
            more = place + depth < len(codes)
            place, node = place[more], node[more]
            key = node * letters + codes[place + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            place, node = place[found], self.children[at[found]]
            depth += 1
        place = np.flatnonzero(length)
        return place, length[place], phrase[place]


def compile_trie(phrases: dict[str, str]) -> Trie:
    """The trie of a table; the empty phrase, and phrases with a NUL, never match."""
    words = sorted(p for p in phrases if p and "\0" not in p)
    used = sorted({c for w in words for c in w})
    code = {c: i + 1 for i, c in enumerate(used)}
    codes = np.zeros(max(map(ord, used), default=0) + 2, np.int64)
    codes[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
    letters = len(used) + 1
    nodes, ends = {-1: 0}, [-1]  # a key that no letter has keeps the arrays filled
    for i, word in enumerate(words):
        node = 0
        for c in word:
            node = nodes.setdefault(node * letters + code[c], len(ends))
            if node == len(ends):
                ends.append(-1)
        ends[node] = i
    keys = np.array(sorted(nodes), np.int64)
    children = np.array([nodes[k] for k in keys.tolist()], np.int64)
    root = np.zeros(letters, np.int64)
    first = (keys >= 0) & (keys < letters)
    root[keys[first]] = children[first]
    return Trie(codes, root, keys[~first], children[~first], np.array(ends, np.int64), [phrases[w] for w in words], max(map(len, words), default=0))


def _leftmost(place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the matches count: from the left, those that begin where the one before has ended or later."""
    following = np.searchsorted(place, place + length)
    if (following == np.arange(1, len(place) + 1)).all():
        return np.arange(len(place))  # none overlap
    chosen, at, jump = [], 0, following.tolist()
    while at < len(jump):
        chosen.append(at)
        at = jump[at]
    return np.array(chosen, np.int64)


def _replaced(texts: list[str | None], trie: Trie, single: dict[int, str]) -> list[str | None]:
    """The texts with the leftmost longest phrases replaced, and single characters in what is left."""
    joined = "\0".join([t or "" for t in texts])
    at = np.cumsum([0, *[len(t or "") + 1 for t in texts]]).tolist()
    place, length, phrase = trie.longest(np.frombuffer(joined.encode("utf-32-le"), np.uint32))
    keep = _leftmost(place, length)
    places, lengths, numbers = place[keep].tolist(), length[keep].tolist(), phrase[keep].tolist()
    of_text = np.searchsorted(place[keep], at).tolist()
    one = (lambda t: t.translate(single)) if single else (lambda t: t)
    out: list[str | None] = []
    for i, text in enumerate(texts):
        parts, before = [], at[i]
        for k in range(of_text[i], of_text[i + 1]):
            parts += [one(joined[before : places[k]]), trie.replacements[numbers[k]]]
            before = places[k] + lengths[k]
        out.append(None if text is None else "".join([*parts, one(joined[before : at[i + 1] - 1])]))
    return out


def replace_phrases(text: Column, phrases: dict[str, str], single: dict[str, str] | None = None) -> Column:
    """The text with phrases replaced by a table of any length, leftmost longest first, and single characters between them by another.

    All places of a batch step through the trie together, so that the cost doesn't grow with
    the number of phrases.  The tables are broadcast; they may hold CHARACTERS characters.
    """
    if sum(len(k) + len(v) for k, v in phrases.items()) > CHARACTERS:
        raise ValueError(f"a table of phrases may hold {CHARACTERS} characters")
    shared = SparkSession.active().sparkContext.broadcast((compile_trie(phrases), str.maketrans(single or {})))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        trie, one = shared.value
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= PIECE:
                out += _replaced(held, trie, one)
                held, size = [], 0
        return pd.Series([*out, *_replaced(held, trie, one)] if held else out, dtype=object)

    return replaced(text)
