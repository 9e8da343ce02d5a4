"""Hashes of words and of runs of words, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 400_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class WordHashes(dict):
    """64-bit hashes of byte words, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of a common hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RunHashes:
    """Polynomial hashes, modulo 2^64, of any run of words of one sequence."""

    def __init__(self, words: np.ndarray, which: int = 0):
        base = BASES[which]
        self.powers = np.ones(len(words) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(words), base, np.uint64), out=self.powers[1:])
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        back = np.ones(len(words) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(words), inverse, np.uint64), out=back[1:])
        seeded = mixed(words + np.uint64(which + 1))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(seeded * back[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same value for the same words, wherever the run starts."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.powers[starts] + (ends - starts).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
