"""Words and their hashes, for the operators that compare runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes are remembered, about 15 MB; beyond it, the memory is emptied.
REMEMBERED = 100_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hashes of words, remembered while a task runs: each task makes its own, so that no worker keeps it for later stages."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        if len(words) <= REMEMBERED:
            return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return np.concatenate([self.of(words[at : at + REMEMBERED]) for at in range(0, len(words), REMEMBERED)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * B
    x = (x ^ (x >> np.uint64(29))) * A
    return x ^ (x >> np.uint64(32))


def run_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive words, from the words' hashes."""
    many = len(words) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(many, salt + n, np.uint64)
    for k in range(n):
        out = out * A + words[k : k + many]
        out ^= out >> np.uint64(29)
    return mixed(out)
