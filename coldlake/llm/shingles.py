"""Word shingles as 64-bit hashes, vectorised with numpy.

A word is a maximal run of bytes outside space and ``\\t \\n \\v \\f \\r``; letters A-Z are
lower-cased first. Words are hashed with xxh64 (seeded) once per distinct word of a batch, and a
shingle hash mixes its words' hashes in order, so equal shingles have equal hashes everywhere.
"""

from __future__ import annotations

import numpy as np
import xxhash

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
ASCII_LOWER = bytes.maketrans(_UPPER, _LOWER)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ROUND = np.uint64(0xBF58476D1CE4E5B9)


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        out = values ^ (values >> np.uint64(31))
        out = out * _ROUND
        out ^= out >> np.uint64(29)
        out = out * _MULT
        out ^= out >> np.uint64(32)
    return out


class WordHasher(dict):
    """Word bytes to 64-bit hash; remembers the distinct words of one batch."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = value
        return value


def shingle_hashes(text: str | None, hasher: WordHasher, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of ``text``.

    Shorter texts give one shingle, the whole word sequence; no word gives an empty array. The
    number of words is mixed in, so that a short sequence never equals a prefix of another.
    """
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))
    span = min(size, len(words))
    n = len(words) - span + 1
    with np.errstate(over="ignore"):
        total = np.full(n, span, np.uint64)
        for k in range(span):
            total *= _MULT
            total += codes[k : k + n]
    total = mix(total)
    total.sort()
    keep = np.ones(n, bool)
    np.not_equal(total[1:], total[:-1], out=keep[1:])
    return total[keep]
