"""Word shingles of whole texts as sets of 64-bit hashes, in NumPy."""

from __future__ import annotations

import numpy as np

WIDTH = 5

_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; with fewer words, one hash of the whole.

    A-Z are lower-cased; words are what ASCII white space separates. Without words
    the set is empty.
    """
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    span = min(n, width)
    out = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        out = out * _K + h[i : n - span + 1 + i]
    return np.unique(mixed(out))
