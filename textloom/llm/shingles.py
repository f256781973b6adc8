"""Distinct word shingles of texts as 64-bit integers, for whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BREAK = r"[^\p{L}\p{N} ]+"


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Keeps the hashes of words it has met."""

    def __init__(self, k: int = 3, memory_words: int = 2_000_000) -> None:
        self.k, self.memory_words = k, memory_words
        self.hashes: dict[str, int] = {}

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word of all texts, number of words of each text); a null text has none."""
        a = pc.utf8_lower(pc.fill_null(texts, ""))
        a = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.replace_substring_regex(a, BREAK, " "), " {2,}", " "))
        lists = pc.split_pattern(a, " ")
        size = np.where(pc.equal(a, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy())
        enc = pc.dictionary_encode(lists.flatten())
        if len(self.hashes) > self.memory_words:
            self.hashes.clear()
        get, own = self.hashes.get, []
        for w in enc.dictionary.to_pylist():
            h = get(w)
            if h is None:
                h = self.hashes[w] = xxhash.xxh3_64_intdigest(w)
            own.append(h)
        idx = enc.indices.to_numpy()
        full = pc.list_value_length(lists).to_numpy()
        if (full != size).any():  # blank texts split into one empty word
            idx = idx[np.repeat(size > 0, full)]
        return np.array(own, dtype=np.uint64)[idx] if len(idx) else np.zeros(0, dtype=np.uint64), size.astype(np.int64)

    def shingles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text index, shingle) of each distinct shingle of each text, sorted by both."""
        h, size = self.words(texts)
        n = len(h) - self.k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        doc = np.repeat(np.arange(len(size)), size)
        s = np.zeros(n, dtype=np.uint64)
        for j in range(self.k):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        ok = doc[:n] == doc[self.k - 1 :]
        doc, s = doc[:n][ok], s[ok]
        order = np.lexsort((s, doc))
        doc, s = doc[order], s[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
        return doc[new], s[new]
