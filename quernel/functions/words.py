"""Words of texts in Arrow batches, for work inside tasks: all words of a batch are cut and looked up at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER = np.zeros(256, bool)
_LETTER[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
#: Cells of a table of sums that is laid out whole; beyond that only the cells in use are. Bytes of substrings that are
#: looked up at once.
_CELLS, _BYTES = 1 << 22, 1 << 23


def cut(texts: pa.Array, least: int = 3) -> tuple[pa.Array, np.ndarray]:
    """(runs of a-z and 0-9 of at least ``least`` letters in lower-case ``texts`` as binary, the row of each)."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = _LETTER[data]
    # Pieces are cut where a text ends and where letters begin or end, so all of them are one array on the same bytes.
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(letter[1:], letter[:-1], out=edge[1:-1])
    edge[ends] = True
    at = np.flatnonzero(edge)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    words = letter[at[:-1]] & (np.diff(at) >= least)
    return pieces.filter(pa.array(words)), np.searchsorted(ends, at[:-1][words], "right") - 1


def places(words: pa.Array, known: list[str]) -> np.ndarray:
    """The place of each word in ``known``, -1 if it is not there."""
    found = pc.index_in(words, pa.array([w.encode() for w in known], pa.large_binary()))
    return found.fill_null(-1).to_numpy().astype(np.int64)


def inside(words: pa.Array, known: list[str], least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, place in ``known``) where a word holds a known one of ``least`` letters or more, by word."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(known):
        by_length.setdefault(len(k.encode()), []).append(i)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    word, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, numbers in by_length.items():
        room = np.maximum(np.diff(ends) - n + 1, 0)
        if n < least or not room.any():
            continue
        data = np.frombuffer(words.buffers()[2], np.uint8)
        origin, at = spread(np.append(0, np.cumsum(room)), np.arange(len(words)))
        at += (ends[:-1] - (np.cumsum(room) - room))[origin]
        of_length = [known[i] for i in numbers]
        for first in range(0, len(at), _BYTES // n + 1):
            some = slice(first, first + _BYTES // n + 1)
            parts = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, n)[at[some]])
            borders = np.arange(len(parts) + 1, dtype=np.int64) * n
            found = places(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(borders), pa.py_buffer(parts)]), of_length)
            word.append(origin[some][found >= 0])
            place.append(np.array(numbers)[found[found >= 0]])
    word, place = np.concatenate(word), np.concatenate(place)
    order = np.argsort(word, kind="stable")
    return word[order], place[order]


def spread(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``which``, place in the table) of all entries of the lists ``which``; list i is starts[i] to starts[i + 1]."""
    sizes = starts[which + 1] - starts[which]
    origin = np.repeat(np.arange(len(which)), sizes)
    return origin, np.arange(len(origin)) + np.repeat(starts[which] - (np.cumsum(sizes) - sizes), sizes)


def sums(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, sum of the values) of each cell that has any, by row and column."""
    cell = row * columns + column
    if rows * columns <= _CELLS:
        at = np.flatnonzero(np.bincount(cell, minlength=1))
        total = np.bincount(cell, value, minlength=1)[at]
    else:
        at, place = np.unique(cell, return_inverse=True)
        total = np.bincount(place, value, minlength=len(at))
    return at // columns, at % columns, total


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, last) of parts of the rows of these sizes, each of about ``most`` or of one row."""
    part = (np.cumsum(sizes) // most).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(a, z) for a, z in zip(edges, edges[1:]) if a < z]


def leading(group: np.ndarray, value: np.ndarray, k: int, near: float) -> np.ndarray:
    """Places of the values that are at most ``near`` below the ``k``-th highest of their group: its best ``k``, with all
    that a tie or rounding may bring among them."""
    order = np.lexsort((-value, group))
    groups, first, size = np.unique(group[order], return_index=True, return_counts=True)
    least = np.full(int(groups[-1]) + 1 if len(groups) else 0, -np.inf)
    least[groups] = np.where(size >= k, value[order][first + np.minimum(k, size) - 1] - near, -np.inf)
    return np.flatnonzero(value >= least[group])


class Ahead:
    """Of values that come in parts, those that may be among the best ``k`` of their group (0 to ``groups`` - 1): at most
    ``near`` below the ``k``-th highest so far, or of its part where a table of all groups would be large. Parts that are
    ``waiting`` may be asked for again."""

    def __init__(self, groups: int, k: int, near: float) -> None:
        self.k, self.near, self.waiting = k, near, []
        self.top = np.full((groups, k), -np.inf) if groups * k <= _CELLS else None

    def places(self, group: np.ndarray, value: np.ndarray) -> np.ndarray:
        if self.top is None:
            return leading(group, value, self.k, self.near)
        at = self.still(group, value)
        groups, size = np.unique(group[at], return_counts=True)
        owner = np.concatenate([group[at], np.repeat(groups, self.k)])
        values = np.concatenate([value[at], self.top[groups].ravel()])
        first = np.cumsum(size + self.k) - (size + self.k)
        self.top[groups] = values[np.lexsort((-values, owner))][first[:, None] + np.arange(self.k)]
        return at[self.still(group[at], value[at])]

    def still(self, group: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Places of the values that by now may be among the best."""
        return np.arange(len(group)) if self.top is None else np.flatnonzero(value >= self.top[group, -1] - self.near)
