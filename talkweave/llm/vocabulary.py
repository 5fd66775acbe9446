"""Byte-level BPE vocabulary files: bytes of tokens, merge ranks, special tokens."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np


def byte_alphabet() -> dict[str, int]:
    """The published printable stand-in of each byte: itself where it is printable, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    token_bytes: list[bytes]  # by id
    byte_id: np.ndarray  # id of each single byte
    pairs: np.ndarray  # left id * 2**32 + right id of every merge, sorted
    rank: np.ndarray  # rank of each of ``pairs``
    merged: np.ndarray  # id that rank makes
    left: np.ndarray  # by rank
    right: np.ndarray
    special: dict[bytes, int]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; -1 where there is none, or an id is negative."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[k] == key) & (left >= 0) & (right >= 0), self.rank[k], -1)


@functools.lru_cache(maxsize=2)
def parse(content: bytes) -> Vocabulary:
    """From the content of a tokenizers JSON file of byte-level BPE with the common word rule."""
    spec = json.loads(content)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
    alphabet, vocab = byte_alphabet(), model["vocab"]
    special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
    if len(special) > 1:
        raise ValueError("one special token at most is supported")
    size = max([*vocab.values(), *special.values()]) + 1
    token_bytes = [b""] * size
    for token, i in vocab.items():
        token_bytes[i] = bytes(alphabet[c] for c in token)
    for token, i in special.items():
        token_bytes[i] = token
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in merges], np.int64)
    right = np.array([vocab[b] for _, b in merges], np.int64)
    merged = np.array([vocab[a + b] for a, b in merges], np.int64)
    key = (left << 32) | right
    order = np.argsort(key, kind="stable")
    byte_id = np.zeros(256, np.int64)
    for c, b in alphabet.items():
        byte_id[b] = vocab[c]
    return Vocabulary(token_bytes, byte_id, key[order], order.astype(np.int64), merged, left, right, special)
