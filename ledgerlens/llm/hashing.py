"""Vectorised rolling hashes of byte strings.

``prefix_sums`` gives S with S[i] = sum of T[b[k]] * p**k for k < i (mod 2**64), p odd, T a fixed
table of random 64-bit values; the hash of b[s:e] is (S[e] - S[s]) * p**-s, so every substring of a
buffer is hashed with two lookups. ``mix`` is a 64-bit finaliser that makes all bits usable.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"n": 0, "p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _geometric(factor: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = factor
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i for i < n, kept by each worker and grown when needed."""
    if _powers["n"] < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers.update(n=size, p=_geometric(_BASE, size), q=_geometric(_INVERSE, size))
    return _powers["p"], _powers["q"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S of a uint8 buffer; one longer than the buffer."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * p[: len(data)], out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of buffer[start:end] for arrays of bounds."""
    _, q = powers(len(sums))
    return mix((sums[end] - sums[start]) * q[start])


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Mixed hash of every q consecutive bytes."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    sums = prefix_sums(data)
    _, inverse = powers(len(sums))
    return mix((sums[q:] - sums[:-q]) * inverse[: len(data) - q + 1])


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(text: str) -> bytes:
    """A-Z lower-cased, words separated by one space; words are runs of bytes other than \\x20 and \\x09-\\x0D."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts and ends of the words of ``words(text)``."""
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return data, np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(data == 32)
    return data, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence when there are fewer words; empty without words."""
    joined = words(text) if text else b""
    data, start, end = word_bounds(joined)
    if not len(start):
        return np.empty(0, np.uint64)
    k = min(width, len(start))
    return np.unique(substring_hashes(prefix_sums(data), start[: len(start) - k + 1], end[k - 1:]))
