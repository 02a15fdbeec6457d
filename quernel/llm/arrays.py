"""Texts of an Arrow batch as flat numpy arrays, and hashes of their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: A-Z hash as a-z do.
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
#: A random number for each place in a span, up to ``_PLACES``; later places draw on two.
_PLACES = 1 << 14
_PLACE = _RNG.integers(0, 2**64, _PLACES, dtype=np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (spans are not empty), alike for alike spans wherever they stand.

    Each place of a span has a random function of its own, so no pattern of values cancels out: any two
    different spans have the same hash with a chance of 2**-64, whatever they are made of.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.cumsum(length) - length
    inner = np.arange(int(length.sum())) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        salt = _PLACE[inner & (_PLACES - 1)]
        if len(far := np.flatnonzero(inner >= _PLACES)):
            salt[far] = mix(salt[far] + (inner[far] >> 14).astype(np.uint64))
        inner += np.repeat(starts, length)
        salt ^= values[inner]
        salt *= _ODD
        salt ^= salt >> np.uint64(32)
        salt *= _ODD
        salt ^= salt >> np.uint64(29)
        return mix(np.add.reduceat(salt, first, dtype=np.uint64) + length.astype(np.uint64) * _ODD)


def text_chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of about ``size`` bytes each; null: empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words in order, offsets of the rows in them).

    A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
    """
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    here, before, after = word[1:-1], word[:-2].copy(), word[2:].copy()
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False  # a row's first byte has nothing before it
    after[inner - 1] = False
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return spans_hash(_LOWER_BYTE[data], starts, ends), np.searchsorted(starts, offsets)
