"""Word-shingle sets and min-max signatures, computed batch-wise with numpy.

A document's words are the maximal runs of characters other than space and
``\\t \\n \\v \\f \\r``; A-Z is lower-cased.  A shingle is ``k`` consecutive
words; a text with 1 to ``k - 1`` words has one shingle, the whole sequence; a
null text or a text without words has the empty set.  A shingle is carried as
a 64-bit hash (two different shingles of one pair of texts collide with a
probability near 2**-64 times the number of shingle pairs compared).
"""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
#: hashes per permutation chunk, bounds the temporary arrays of a batch
_CHUNK = 1 << 19


class _WordHashes(dict):
    """word -> 64-bit hash; emptied when it holds ``limit`` words."""

    limit = 400_000

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text as UTF-8 bytes."""
    if text is None:
        return []
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return text.lower().split()  # bytes: ASCII white space and A-Z only


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text, k: int, cache: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of one text."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    cache = _WordHashes() if cache is None else cache
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    k = min(k, n)
    # the length enters, so that a whole short sequence differs from a shingle of more words
    s = np.full(n - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j:n - k + 1 + j])
    return np.unique(s)


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` hash functions x -> a * x + b modulo 2**64."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, _MASK, n, np.uint64, endpoint=True) | np.uint64(1)
    return a, rng.integers(0, _MASK, n, np.uint64, endpoint=True)


def min_max_signatures(sets: list[np.ndarray], n_hashes: int, seed: int) -> np.ndarray:
    """Signature of every non-empty set: minimum and maximum under each hash, 2 * n_hashes columns.

    Under a random permutation the smallest and the largest element of a union are each equally
    likely to be any element, so either agrees between two sets with probability J, and the two
    are negatively correlated: half the evaluations, a lower variance (min-max hashing).
    """
    a, b = permutations(n_hashes, seed)
    out = np.empty((len(sets), 2 * n_hashes), np.uint64)
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= _CHUNK):
            total += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        at = np.cumsum([0] + [len(s) for s in sets[i:j - 1]])
        with np.errstate(over="ignore"):
            for p in range(n_hashes):
                v = x * a[p] + b[p]
                out[i:j, 2 * p] = np.minimum.reduceat(v, at)
                out[i:j, 2 * p + 1] = np.maximum.reduceat(v, at)
        i = j
    return out


def band_keys(signatures: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` signature values; the band's number enters the key.

    Bands take minima and maxima from different hashes: values of one band are independent.
    """
    n, width = signatures.shape
    halves = np.concatenate([signatures[:, 0::2], signatures[:, 1::2]], axis=1)
    bands = width // rows
    keys = np.empty((n, bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            k = np.full(n, (seed * 1_000_003 + band) & _MASK, np.uint64)
            for r in range(rows):
                k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + halves[:, band * rows + r])
            keys[:, band] = k
    return keys
