"""Words of a text, and hashes of runs of consecutive words, for whole Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import regex
import xxhash

_formats = regex.compile(r"\p{Cf}+")
_words = regex.compile(r"[\p{L}\p{N}]+")
_ascii_words = re.compile(r"[a-z0-9]+")
#: Words whose hash a worker keeps.
KEPT = 1 << 20


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case, after format characters are removed."""
    if not text:
        return []
    if text.isascii():
        return _ascii_words.findall(text.lower())
    return [w.lower() for w in _words.findall(_formats.sub("", text))]


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; kept for the words met first."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT:
            self[word] = h
        return h

    def of(self, lists: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all lists in one array, and where each list starts (one more entry than lists)."""
        get, flat, starts = self.__getitem__, [], [0]
        for ws in lists:
            flat.extend(map(get, ws))
            starts.append(len(flat))
        return np.array(flat, dtype=np.uint64), np.array(starts, dtype=np.int64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive entries; the caller drops those that go across two lists."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - k + 1 + i]
    return mix64(h)
