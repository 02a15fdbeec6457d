"""A covering code of 46 bits: two words of the perfect binary Golay code of 23 bits.

The 4096 words of the Golay code lie so that each of the 2**23 strings is within three bits of exactly one. All is
linear: the strings of one syndrome differ from code words by the same error patterns.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011
LENGTH, CHECKS, RADIUS = 23, 11, 3


@lru_cache(1)
def _single() -> np.ndarray:
    """The syndrome (remainder by the generator) of each single bit."""
    found = []
    for i in range(LENGTH):
        r = 1 << i
        for shift in range(LENGTH - 1, CHECKS - 1, -1):
            if r >> shift & 1:
                r ^= _GENERATOR << (shift - CHECKS)
        found.append(r)
    return np.array(found, np.int64)


def syndromes(words: np.ndarray) -> np.ndarray:
    """The syndrome of each string of 23 bits."""
    out = np.zeros(len(words), np.int64)
    for i, s in enumerate(_single()):
        out ^= (words >> i & 1) * s
    return out


@lru_cache(4)
def errors(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(error patterns sorted by syndrome and by weight beyond the covering radius, offsets of each (syndrome, weight
    beyond) in them): the code words within ``RADIUS + reach`` bits of a
    string are the string without each pattern of its syndrome."""
    patterns = [sum(1 << i for i in bits) for w in range(RADIUS + reach + 1) for bits in combinations(range(LENGTH), w)]
    patterns = np.array(patterns, np.int64)
    weight = np.bitwise_count(patterns).astype(np.int64)
    beyond = np.maximum(weight - RADIUS, 0)
    key = syndromes(patterns) * (reach + 1) + beyond
    order = np.argsort(key, kind="stable")
    offsets = np.searchsorted(key[order], np.arange((1 << CHECKS) * (reach + 1) + 1))
    return patterns[order], offsets


def anchors(words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``words``, anchor of 24 bits) for all pairs of code words of which the halves of a string of 46
    bits are together at most ``reach`` bits farther than the covering radius. The first of a string, at ``reach`` 0
    the only one, is its own anchor."""
    patterns, offsets = errors(reach)
    low, high = words & (1 << LENGTH) - 1, words >> LENGTH & (1 << LENGTH) - 1
    halves = [(half, syndromes(half)) for half in (low, high)]
    rows, found = [], []
    for a in range(reach + 1):
        for b in range(reach + 1 - a):
            (x, sx), (y, sy) = halves
            i, j = sx * (reach + 1) + a, sy * (reach + 1) + b
            n, m = offsets[i + 1] - offsets[i], offsets[j + 1] - offsets[j]
            row = np.repeat(np.arange(len(words)), n * m)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            first = (x[row] ^ patterns[offsets[i][row] + place // m[row]]) >> CHECKS
            second = (y[row] ^ patterns[offsets[j][row] + place % m[row]]) >> CHECKS
            rows.append(row)
            found.append(first | second << (LENGTH - CHECKS))
    return np.concatenate(rows), np.concatenate(found)
