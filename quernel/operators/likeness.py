"""Bounds on the ratio of difflib's matcher, for all pairs of two blocks of texts at once. None rules out a like pair."""

from __future__ import annotations

import numpy as np

#: Columns of the vectors of counts; the matcher's steps that are taken; runs that are looked at together, and those of one
#: text that are too many; characters of a side that are looked at together.
_COLUMNS, _STEPS, _TOGETHER, _MOST, _CHARACTERS = 1024, 12, 1 << 17, 1 << 20, 1 << 21
#: Shared runs of a pair that are looked for, and how long texts are on average for which it is faster than what comes after.
_RUNS, _SHORT = 32, 240
#: Bits of a place in a text, where the longest run, then the first place is the largest number.
_PLACE = 21
_LAST = (1 << _PLACE) - 1


def near(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have characters enough in common, from counts by text. The smaller of two counts is the number of steps
    that both reach, so all pairs are one product of matrices; where counts are high, a step is of several."""
    most = np.minimum(left.max(axis=0), right.max(axis=0))
    step = max(1, -(-int(most.sum()) // _COLUMNS))
    while int((-(-most // step)).sum()) > max(_COLUMNS, len(most)):
        step += 1
    reached = []
    for counts in (left, right):
        steps = [counts[:, most > at] > at for at in range(0, int(most.max()), step)]
        reached.append(np.concatenate(steps or [np.zeros((len(counts), 0), bool)], axis=1).astype(np.float32))
    shared = step * (reached[0] @ reached[1].T)
    return 2 * shared >= least * (left.sum(axis=1)[:, None] + right.sum(axis=1)) - 1e-9


class _Texts:
    """Texts of a block in one array of codes, an end before, between and after them."""

    def __init__(self, texts: list[str], points: np.ndarray, rank: np.ndarray, end: int, bits: int):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = 1 + np.cumsum(self.sizes + 1) - (self.sizes + 1)
        codes = np.full(1 + int((self.sizes + 1).sum()), end, np.int64)
        self.text = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), np.append(self.sizes + 1, 1))
        inside = np.ones(len(codes), bool)
        inside[np.append(self.starts - 1, len(codes) - 1)] = False
        codes[inside] = rank[points]
        # Each place with the characters after it in one number, the nearest in the lowest bits.
        self.ahead = codes.copy()
        have, most = 1, 63 // bits
        while have < most:
            more = min(have, most - have)
            self.ahead[:-have] |= (self.ahead[have:] & ((1 << (bits * more)) - 1)) << (bits * have)
            have += more
        self.codes = codes.astype(np.uint8 if bits <= 8 else np.int32)

    def heads(self, k: int, bits: int, low: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the ``k`` characters from each place, in order, and their places, which have ``low`` bits)."""
        mixed = (self.ahead & ((1 << (bits * k)) - 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(low)
        both = np.sort(mixed << np.uint64(low) | np.arange(len(mixed), dtype=np.uint64))
        return both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(np.int32)


def _width(left: np.ndarray, right: np.ndarray, bits: int, runs: int) -> int:
    """The least width at which texts share no more than ``runs``, from some of the places: it only decides how fast it goes."""
    most = 63 // bits
    steps = [-(-len(x) // 4096) for x in (left, right)]
    # Not the same places, as a block may meet itself.
    some = left[:: steps[0]], right[steps[1] // 2 :: steps[1]]
    scale = len(left) / len(some[0]) * len(right) / len(some[1])
    for k in range(min(4, most), most):
        a, b = (np.sort(x & ((1 << (bits * k)) - 1)) for x in some)
        if scale * (np.searchsorted(b, a, "right") - np.searchsorted(b, a)).sum() <= runs:
            return k
    return most


def _stay(n: np.ndarray, m: np.ndarray, most: np.ndarray, swapped: np.ndarray, k: int, pair: np.ndarray, i: np.ndarray, j: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which pairs may leave as few characters unmatched as ``most``, from all their common runs of ``k`` and more (the pair, the
    places and the length of each).

    The matcher takes the longest common run, of these the first in its first text, then the first in its second, and goes on left and
    right of it. So its first steps are known, and each leaves two boxes, in which at least the difference of the sides is
    unmatched. In a box without a run of ``k`` there is an unmatched character between any two runs that it takes, as they
    would else be one longer run.
    """

    def least(box: list[np.ndarray]) -> np.ndarray:
        a, b = box[1] - box[0], box[3] - box[2]
        return np.maximum(np.abs(a - b), a + b - 2 * ((a + b + 1) * (k - 1) // (2 * k - 1)))

    def sums(of: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(of, x, len(n))

    none = np.zeros(len(n), np.int64)
    box, of, at = [none, n, none, m], np.arange(len(n)), pair
    closed = np.zeros(len(n))
    for _ in range(_STEPS):
        turned = swapped[of[at]]
        best = np.zeros(len(of), np.int64)
        np.maximum.at(best, at, run << (2 * _PLACE) | (_LAST - np.where(turned, j, i)) << _PLACE | (_LAST - np.where(turned, i, j)))
        found, lost = np.flatnonzero(best), np.flatnonzero(best == 0)
        closed += sums(of[lost], least([x[lost] for x in box]))
        at = (np.cumsum(best > 0) - 1)[at]
        best, of, box = best[found], of[found], [x[found] for x in box]
        long, x, y = best >> (2 * _PLACE), _LAST - (best >> _PLACE & _LAST), _LAST - (best & _LAST)
        x, y = np.where(swapped[of], y, x), np.where(swapped[of], x, y)
        box = [np.stack(s, axis=1).ravel() for s in ((box[0], x + long), (x, box[1]), (box[2], y + long), (y, box[3]))]
        unmatched = closed + sums(np.repeat(of, 2), np.abs(box[1] - box[0] - box[3] + box[2]))
        on = np.flatnonzero((unmatched <= most)[of][at])
        at, i, j, run, of = at[on], i[on], j[on], run[on], np.repeat(of, 2)
        # A run goes on in the box on its side, cut off at its borders; none is long enough for both.
        right, down = x[at] - i, y[at] - j
        room = np.minimum(right, down)
        before = room > 0
        cut = np.where(before, 0, np.maximum(np.maximum(right, down) + long[at], 0))
        run = np.where(before, np.minimum(run, room), run - cut)
        on = np.flatnonzero(run >= k)
        at, i, j, run = (2 * at + ~before)[on], (i + cut)[on], (j + cut)[on], run[on]
        if not len(at):
            # What is out stays out: the bound is no less than the difference of the sides.
            unmatched = closed + sums(of, least(box))
            break
    return unmatched <= most


def by_first_steps(left: list[str], right: list[str], swapped: np.ndarray, pairs: np.ndarray, least: float) -> np.ndarray:
    """Which of ``pairs`` may still be alike after the matcher's first steps, which take the longest common runs: those of unlike
    texts lie far apart. ``swapped`` says for which pairs the right text is the matcher's first."""
    lefts, rights = ([len(t) for t, on in zip(side, pairs.any(axis=axis)) if on] for side, axis in ((left, 1), (right, 0)))
    if not lefts or np.mean(lefts) + np.mean(rights) < 2 * _SHORT or max(lefts + rights) >= _LAST:
        return pairs
    for axis, side in enumerate((left, right)):
        if len(side) > 1 and sum(map(len, side)) > _CHARACTERS:
            half = len(side) // 2
            cut = [slice(0, half), slice(half, None)]
            parts = [(left, right[c], swapped[:, c], pairs[:, c]) if axis else (left[c], right, swapped[c], pairs[c]) for c in cut]
            return np.concatenate([by_first_steps(*part, least) for part in parts], axis=axis)
    points = [np.frombuffer("".join(side).encode("utf-32-le"), "<u4") for side in (left, right)]
    known = np.zeros(0x110000, bool)
    for p in points:
        known[p] = True
    rank = np.cumsum(known) - 1
    end = int(rank[-1]) + 1
    bits = (end + 1).bit_length()
    # The ends of the two sides differ, so no run goes over one.
    a, b = (_Texts(side, p, rank, e, bits) for side, p, e in ((left, points[0], end), (right, points[1], end + 1)))
    k = _width(a.ahead, b.ahead, bits, _RUNS * int(pairs.sum()))
    low = max(len(x.codes) for x in (a, b)).bit_length()
    heads, order = b.heads(k, bits, low)
    first = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
    heads, many = heads[first], np.diff(np.append(first, len(order)))
    mine, places = a.heads(k, bits, low)
    where = np.minimum(np.searchsorted(heads, mine), len(heads) - 1)
    count, start = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
    count[places], start[places] = np.where(heads[where] == mine, many[where], 0), first[where]
    # Left texts by as many as have few enough runs together; one that has too many by itself keeps its pairs.
    totals = np.add.reduceat(count, a.starts - 1)
    kept, row, upto = pairs.copy(), 0, np.append(0, np.cumsum(totals))
    while row < len(totals):
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] + _TOGETHER, "right")) - 1)
        if totals[row] <= _MOST:
            kept[row:stop] = _rows(a, b, slice(row, stop), count, start, order, swapped[row:stop], pairs[row:stop], least, bits, k)
        row = stop
    return kept


def _rows(a: _Texts, b: _Texts, rows: slice, count: np.ndarray, start: np.ndarray, order: np.ndarray, swapped: np.ndarray, pairs: np.ndarray, least: float, bits: int, k: int) -> np.ndarray:
    """``by_first_steps`` of some left texts. ``count`` and ``start`` say which places of ``order`` begin as a left place does."""
    low = int(a.starts[rows.start])
    high = int(a.starts[rows.stop]) if rows.stop < len(a.starts) else len(a.codes)
    some = count[low:high]
    p = np.repeat(np.arange(low, high, dtype=np.int32), some)
    q = order[np.arange(len(p)) + np.repeat(start[low:high] - np.cumsum(some) + some, some)]
    # Runs from their beginnings only.
    pair = (a.text[p] - rows.start) * np.int32(len(b.sizes)) + b.text[q]
    on = np.flatnonzero(pairs.ravel()[pair] & (a.codes[p - 1] != b.codes[q - 1]))
    p, q, pair = p[on], q[on], pair[on]
    width = 63 // bits
    unlike = a.ahead[p] ^ b.ahead[q]
    run = np.where(unlike == 0, width, np.bitwise_count((unlike & -unlike) - 1) // bits).astype(np.int64)
    more = np.flatnonzero(unlike == 0)
    while len(more):
        unlike = a.ahead[p[more] + run[more]] ^ b.ahead[q[more] + run[more]]
        run[more] += np.where(unlike == 0, width, np.bitwise_count((unlike & -unlike) - 1) // bits)
        more = more[unlike == 0]
    # Hashes of other characters may be the same.
    on = np.flatnonzero(run >= k)
    p, q, pair, run = p[on], q[on], pair[on], run[on]
    n, m = np.repeat(a.sizes[rows], len(b.sizes)), np.tile(b.sizes, pairs.shape[0])
    stay = _stay(n, m, n + m - least * (n + m) + 1e-9, swapped.ravel(), k, pair, p - a.starts[a.text[p]], q - b.starts[b.text[q]], run)
    return pairs & stay.reshape(pairs.shape)
