"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

KEPT_WORDS = 50_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))  # odd, bits evenly mixed


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxh64_intdigest(word)
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found
        return found


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def gram_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of size words; w: hashes of the words."""
    if len(w) < size:
        return np.zeros(0, np.uint64)
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h *= _A
        h += w[k : len(w) - size + 1 + k]
    h ^= np.uint64(size * 0x51ED27)
    return _mixed(h)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Distinct shingles of n words, A-Z lower-cased; with fewer words the whole sequence is one; without
    words none. bytes.lower() and bytes.split() know ASCII letters and the six ASCII spaces only."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = gram_hashes(word_hashes(words), min(n, len(words)))
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]
