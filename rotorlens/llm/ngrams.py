"""Vectorised words and n-gram hashes over the raw UTF-8 bytes of many documents at once.

A word's hash is a polynomial over its bytes (mod 2^64, taken from prefix sums, so that all
words of a block are hashed by a few array operations) followed by a bit mixer.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: byte -> the same with A-Z lowered
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Lookup table: True for word bytes, False for those in the (closed) separator ranges."""
    t = np.ones(256, bool)
    for a, b in ranges:
        t[a:b + 1] = False
    return t


#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lowering A-Z
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: words `[^\x20\x09-\x0D]+`
BLANK = byte_class([(0x20, 0x20), (0x09, 0x0D)])


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        m = max(n, 1 << 20) + 1
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(m, base, U)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    p, q = _powers["p"][:n], _powers["q"][:n]
    if n > 1 << 21:  # a very long text: don't keep its tables
        _powers.clear()
    return p, q


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def words(data: np.ndarray, offs: np.ndarray, keep: np.ndarray):
    """Start and end (bytes) of each word, its document's index, and its 64-bit hash."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    low = LOWER[data]
    is_w = keep[low]
    cut = np.zeros(n + 1, bool)            # a document begins here
    cut[offs[:-1]] = True
    cut[0] = cut[n] = True
    edge = cut.copy()                      # a word may begin or end here
    edge[1:n] |= is_w[1:] != is_w[:-1]
    starts = np.flatnonzero(is_w & edge[:n])
    ends = np.flatnonzero(is_w & edge[1:]) + 1
    doc = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, doc, span_hash(low, starts, ends)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    n = len(data)
    p, q = _power(n + 1)
    acc = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[:n], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(U))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (len(h) - k + 1 of them, also across documents)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    g = np.zeros(m, U)
    for j in range(k):
        g = g * U(0xD6E8FEB86659FD93) + h[j:j + m]
    return mix(g)
