"""Content-defined positions of byte strings: hashes of grams, and which grams to keep."""

from __future__ import annotations

import numpy as np

#: Odd base of the polynomial hashes modulo 2^64, and a second one for contexts.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hasher:
    """Hashes of substrings of a byte string, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        with np.errstate(over="ignore"):
            self.inverse = np.full(n + 1, _INVERSES[which])
            self.inverse[0] = 1
            np.multiply.accumulate(self.inverse, out=self.inverse)
            power = np.full(n, BASES[which])
            if n:
                power[0] = 1
            np.multiply.accumulate(power, out=power)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[which][data] * power, out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return finish((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def grams(self, length: int) -> np.ndarray:
        """Hash of the gram at each position."""
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return finish((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)


def finish(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, reduce) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = reduce(x[: len(x) - step], x[step:])
        done += step
    return x


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` hashes from each position on (upper halves)."""
    return _sliding((h >> np.uint64(32)).astype(np.uint32), width, np.minimum) if len(h) >= width else np.empty(0, np.uint32)


def chosen(h: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the least of some run of ``width``: a function of each run alone."""
    if not len(least):
        return np.empty(0, np.int64)
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    return np.flatnonzero(_sliding(padded, width, np.maximum) == (h >> np.uint64(32)).astype(np.uint32))
