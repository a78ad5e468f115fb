"""Byte-level word splitting and hashing shared by the corpus operators.

All helpers run inside Spark tasks and keep only bounded state. A null text is
the empty text everywhere.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z become a-z; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and every ASCII byte that is neither a letter nor a digit becomes a space.
#: UTF-8 lead and continuation bytes are above 0x7F, so they stay inside words.
WORDS = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(WORDS).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(LOWER).split()


class WordHashes(dict):
    """word -> 64-bit hash, the same in every worker; forgets all when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole run if it is shorter; none if there are no words."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : n - width + 1 + k])
    return out
