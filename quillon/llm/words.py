"""64-bit hashes of words and of runs of words, over whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered by one task; the memory starts anew when it is full.
MEMORY = 100_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word (bytes or str), computed once while remembered."""

    def __missing__(self, word) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the input; different stay different."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive word hashes, in order."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            out = mixed(out * _MULTIPLIER + words[i : i + n])
    return out


def shingles(text: str | None, length: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``length`` words of a text.

    A-Z are lower-cased and words are maximal runs without ASCII white space. A text with
    fewer words gives its whole sequence as one run, and one without words gives none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(runs(h, length)) if len(h) >= length else mixed(runs(h, len(h)) + np.uint64(len(h)))
