"""Token ids of a byte-level BPE vocabulary, a batch at a time.

Splitting into pieces is done on flat arrays of code points, equal pieces are found by hash and then
compared code point by code point, and only pieces not seen before go through the BPE merges. The ids are those that the ``tokenizers`` library
gives for the same file without special tokens (tests hold the two together).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from quernel.llm.arrays import mix, spans_hash

LETTER, NUMBER, SPACE, OTHER, END = 1, 2, 3, 4, 5
#: White space as Unicode's White_Space property has it.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Pieces kept between batches, and their code points, at most; the memory stays below about 30 MB.
CACHE = 150_000
CACHE_CODES = 2_000_000
#: Code points worked on at a time.
CHUNK = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


def piece_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point. Each text ends in one place of class END (at ends - 1).

    A piece is a contraction, a run of letters, numbers or others with the space before it, or white
    space: of a run of white space before a word the last place stands apart.
    """
    kind = _classes()[codes]
    kind[ends - 1] = END
    n = len(kind)
    before = np.concatenate(([END], kind[:-1]))
    after = np.concatenate((kind[1:], [END]))
    blank = (codes == 32) & (kind == SPACE)
    space = kind == SPACE
    start = kind != before  # the first place of every run
    start |= space & ~((after == SPACE) | (after == END))  # the last white space before a word
    after_blank = np.concatenate(([False], blank[:-1]))
    start &= ~(after_blank & ~space & (kind != END))  # a space belongs to the word that follows
    # Contractions start with an apostrophe that starts a piece and has a letter after it.
    at = np.flatnonzero((codes == 39) & start & (after == LETTER) & (kind == OTHER))
    if len(at):
        one = codes[np.minimum(at + 1, n - 1)]
        two = codes[np.minimum(at + 2, n - 1)]
        pair = (kind[np.minimum(at + 2, n - 1)] == LETTER) & (
            ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        )
        single = np.isin(one, (115, 116, 109, 100))
        start[at[single | pair] + 1] = False
        start[at[single] + 2] = True
        start[at[~single & pair] + 3] = True
    return start


class Encoder:
    """Ids of texts; keeps what it has learned of pieces between batches."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        # The byte alphabet of byte-level BPE: printable bytes stand for themselves, others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = sorted(special.items())
        # One alternative that takes everything: only whole pieces come here.
        self._bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._reset()

    def _reset(self) -> None:
        self._hash = np.zeros(0, np.uint64)
        self._at = np.zeros(0, np.int64)
        self._len = np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.uint32)
        # The code points of the pieces, and where those of each piece start and how many they are.
        self._codes = np.zeros(0, np.uint32)
        self._code_at = np.zeros(0, np.int64)
        self._code_len = np.zeros(0, np.int64)

    def _bpe_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each piece)."""
        ids = [self._bpe.encode_ordinary(p) for p in pieces]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(length.sum())), length

    def _full(self) -> bool:
        return len(self._hash) > CACHE or len(self._codes) > CACHE_CODES

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, code_len: np.ndarray, pieces: list[str]) -> None:
        if self._full():
            self._reset()
        ids, length = self._bpe_ids(pieces)
        at = len(self._flat) + np.cumsum(length) - length
        code_at = len(self._codes) + np.cumsum(code_len) - code_len
        self._flat, self._codes = np.concatenate((self._flat, ids)), np.concatenate((self._codes, codes))
        order = np.argsort(merged := np.concatenate((self._hash, hashes)), kind="stable")
        self._hash = merged[order]
        self._at, self._len = np.concatenate((self._at, at))[order], np.concatenate((self._len, length))[order]
        self._code_at = np.concatenate((self._code_at, code_at))[order]
        self._code_len = np.concatenate((self._code_len, code_len))[order]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the cache, whether it is there)."""
        if not len(self._hash):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self._hash, hashes), len(self._hash) - 1)
        return at, self._hash[at] == hashes

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of the rows one after another, offsets of the rows in them)."""
        first = 0
        while first < len(texts):
            rows, size = [], 0
            while first + len(rows) < len(texts) and (not rows or size < CHUNK):
                rows.append(texts[first + len(rows)] or "")
                size += len(rows[-1]) + 1
            yield first, *self._encode(rows)
            first += len(rows)

    def _encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any(s in r for s, _ in self.special for r in rows):
            return self._encode_with_special(rows)
        whole = "\n".join(rows) + "\n"  # the added place of each row is of class END
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) + 1)
        starts = np.flatnonzero(piece_starts(codes, ends))
        stops = np.concatenate((starts[1:], [len(codes)]))
        real = np.ones(len(codes), bool)
        real[ends - 1] = False
        kept = real[starts]
        starts, stops = starts[kept], stops[kept]
        hashes = spans_hash(mix(codes.astype(np.uint64) + np.uint64(1)), starts, stops)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        size = stops - starts
        at, known = self._find(unique)
        if not known.all():
            new = np.arange(len(unique)) if self._full() else np.flatnonzero(~known)
            first, n = starts[where[new]], size[where[new]]
            self._learn(unique[new], codes[_ranges(first, n)], n, [whole[a : a + k] for a, k in zip(first.tolist(), n.tolist())])
            at, _ = self._find(unique)
        at = at[inverse]
        length, place, flat = self._len[at], self._at[at], self._flat
        # A hash finds a piece, its code points decide: pieces that share a hash with another are encoded for themselves.
        alike = self._code_len[at] == size
        same = self._codes[_ranges(self._code_at[at][alike], size[alike])] == codes[_ranges(starts[alike], size[alike])]
        if len(same):
            alike[alike] = np.logical_and.reduceat(same, np.cumsum(size[alike]) - size[alike])
        if not alike.all():
            odd = np.flatnonzero(~alike)
            more, n = self._bpe_ids([whole[starts[i] : stops[i]] for i in odd])
            length[odd], place[odd] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate((flat, more))
        total = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.repeat(place - total[:-1], length) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, np.concatenate(([0], ends)))]

    def _encode_with_special(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A special token in a text has its own id; what stands between is ordinary text."""
        out, offsets = [], [0]
        for row in rows:
            parts = [row]
            for s, i in self.special:
                parts = [y for x in parts for y in (_interleave(x.split(s), i) if isinstance(x, str) else [x])]
            for x in parts:
                out.append(self._encode([x])[0] if isinstance(x, str) else np.array([x], np.uint32))
            offsets.append(sum(map(len, out)))
        return np.concatenate(out), np.array(offsets)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start .. start + length of each, one after another."""
    done = np.cumsum(length)
    return np.arange(int(done[-1]) if len(done) else 0) + np.repeat(start - done + length, length)


def _interleave(parts: list[str], i: int) -> list:
    return [y for k, x in enumerate(parts) for y in ((i, x) if k else (x,))]


@cache
def encoder(vocabulary: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(vocabulary)


def document_ids(
    column: pa.Array, vocabulary: str, end_id: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``Encoder.encode``, with ``end_id`` after the ids of each text."""
    for first, ids, offsets in encoder(vocabulary).encode(column.to_pylist()):
        n = len(offsets) - 1
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
        yield first, out, offsets + np.arange(n + 1)
