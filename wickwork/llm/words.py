"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

Words are the maximal runs of bytes other than ASCII white space, with A-Z lowered. A word's hash
is a sum of random 64-bit values of its bytes times powers of an odd constant, mixed; a shingle's
hash combines those of its words. Work goes in slices of bounded size, cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once (a longer word is handled whole).
SLICE = 1 << 20

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_value = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_value[65:91] = _value[97:123]
_odd, _a, _b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _odd, np.uint64)]) if n > 0 else np.zeros(0, np.uint64)


_power = _powers(4096)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _a
    x = (x ^ (x >> np.uint64(27))) * _b
    return x ^ (x >> np.uint64(31))


def _spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that end at ``bounds``."""
    word = ~_space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = word[inner]
    last = np.zeros(len(data) + 1, bool)
    last[1:] = word
    last[1:-1] &= ~word[1:]
    last[inner] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last)


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    global _power
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    length = end - start
    if length.max() > len(_power):
        _power = _powers(int(length.max()))
    at = np.flatnonzero(~_space[data])  # the words' bytes
    inside = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    return mix(np.add.reduceat(_value[data[at]] * _power[inside], np.cumsum(length) - length))


def hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, word hashes, word offsets per text), for slices of whole texts."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(max(i + 1, np.searchsorted(offsets, offsets[i] + SLICE, side="right") - 1))
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1 and len(part) > 2 * SLICE:
            found = np.concatenate([_hash(s, *_spans(s, np.zeros(0, np.int64))) for s in _cut(part)])
            yield i, j, found, np.array([0, len(found)])
        else:
            start, end = _spans(part, bounds)
            yield i, j, _hash(part, start, end), np.searchsorted(start, bounds)
        i = j


def _cut(part: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in slices that end at white space."""
    a = 0
    while a < len(part):
        b = a + SLICE
        if b < len(part):
            while b < len(part):
                gap = np.flatnonzero(_space[part[b : b + SLICE]])
                if len(gap):
                    b += int(gap[0])
                    break
                b += SLICE
        yield part[a : min(b, len(part))]
        a = b


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text's words: k words each; fewer words make one; none make none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    m = min(n, k)
    h = np.full(n - m + 1, m, np.uint64)
    for t in range(m):
        h = (h + words[t : n - m + 1 + t]) * _odd
        h ^= h >> np.uint64(29)
    return np.unique(mix(h))
