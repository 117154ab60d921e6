"""Hashes of word shingles, shared by the operators on near duplicates."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes a task remembers; at the limit it starts anew.
REMEMBERED = 100_000
_M1, _M2, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(33)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: each input bit moves half of the output bits."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


class Words(dict):
    """64-bit hashes of words (bytes without ASCII white space)."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, text: str) -> np.ndarray:
        return self.of_bytes(text.encode("utf-8", "surrogatepass"))

    def of_bytes(self, text: bytes) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; fewer words (but one at least) are one shingle."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = h * _B + words[k : len(words) - n + 1 + k]
        return np.unique(mixed(h))
