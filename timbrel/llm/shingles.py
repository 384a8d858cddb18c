"""Word shingles of whole texts as 64-bit hashes, in numpy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20_240_229)
#: A random value for each byte, A-Z as a-z.
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_STEP = _rng.integers(1, 2**62, 64, dtype=np.uint64) * 2 + 1
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers = tuple(out)
    return _powers[0][:n], _powers[1][:n]


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, in order, and the n + 1 offsets of the texts' words. A word: bytes other than ASCII white
    space, A-Z counted as a-z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[data]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge] |= inside[edge]
    stop[edge - 1] |= inside[edge - 1]
    at, to = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power, out=total[1:])
    hashes = mix((total[to] - total[at]) * inverse[at] + (to - at).astype(np.uint64))
    return hashes, np.searchsorted(at, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, ascending, and the n + 1 offsets of the texts. A text of fewer words
    has its whole sequence as one shingle; one without words has none."""
    word, at = words(data, ends)
    count = np.diff(at)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_at = np.zeros(len(ends), np.int64)
    np.cumsum(many, out=out_at[1:])
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    doc = np.repeat(np.arange(len(many)), many)
    first = at[:-1][doc] + np.arange(len(doc)) - out_at[:-1][doc]
    left = np.minimum(count, k)[doc]
    h = np.zeros(len(doc), np.uint64)
    short = left < k
    any_short = bool(short.any())
    for i in range(k):
        term = padded[first + i] * _STEP[i]
        if any_short and i:
            term[left <= i] = 0
        h += term
    h += left.astype(np.uint64) * _STEP[63]
    h = mix(h)
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    kept = np.zeros(len(h) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return h[new], kept[out_at]
