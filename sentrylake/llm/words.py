"""Words of many texts at once, as arrays: places in the joined bytes and 64-bit hashes.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D); hashes ignore the case of A-Z. Two different
words of the sets that are compared share a hash with probability near 2**-64 for each pair.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_rng = np.random.default_rng(701)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[SPACE] = 0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        out = np.full(1 << (n - 1).bit_length(), _ODD, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    raw: np.ndarray  # joined bytes
    first: np.ndarray  # of each text, its first byte; one more for the end
    start: np.ndarray  # of each word
    end: np.ndarray
    hash: np.ndarray
    bound: np.ndarray  # of each text, its first word; one more for the end


def words(texts: list[bytes], breaks: np.ndarray = SPACE) -> Words:
    """breaks: which bytes part words."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(raw, first, none, none, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    solid = ~breaks[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[first] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return Words(raw, first, start, end, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    size = end - start
    step = np.diff(np.append(start, len(raw)))
    at = np.arange(start[0], len(raw)) - np.repeat(start, step)
    longest = int(size.max())
    value = np.where(solid, _BYTE[raw], np.uint64(0))[start[0] :] * powers(longest)[np.minimum(at, longest - 1)]
    h = mix(np.add.reduceat(value, start - start[0]) + size.astype(np.uint64))
    return Words(raw, first, start, end, h, np.searchsorted(start, first))


_MULTIPLIERS = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words of each text, in order, and the bounds of each text's.

    A text of 1 to n-1 words has one: the whole of its words."""
    count = np.diff(w.bound)
    out_count = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bound = np.zeros(len(count) + 1, np.int64)
    np.cumsum(out_count, out=bound[1:])
    h = w.hash
    if len(h) >= n:
        total = len(h) - n + 1
        run = h[:total] * _MULTIPLIERS[0]
        for k in range(1, n):
            run = mix(run) + h[k : k + total] * _MULTIPLIERS[k]
        run = mix(run + np.uint64(n))
    else:
        run = np.zeros(0, np.uint64)
    out = np.zeros(bound[-1], np.uint64)
    long = count >= n
    src = np.repeat(w.bound[:-1][long] - bound[:-1][long], out_count[long])
    at = np.repeat(long, out_count)
    where = np.flatnonzero(at)
    out[where] = run[where + src]
    for i in np.flatnonzero((count > 0) & (count < n)):
        v = np.array([count[i]], np.uint64)
        for k in range(count[i]):
            v = mix(v * _MULTIPLIERS[k] + h[w.bound[i] + k])
        out[bound[i]] = v[0]
    return out, bound
