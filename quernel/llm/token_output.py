"""Binary token output: best-fit-decreasing packing with a segment tree over room left.

Within a task, documents are taken up to a bounded number of tokens; their pieces, longest first, go
into the sequence with the least room that still takes them, found in a segment tree over the amounts
of room. Nothing is shuffled: each task writes the sequences of its own documents. An overlong
document is cut into whole sequences and a rest, so no id is lost or moved.

Each row is a packed sequence: its ids padded to the full length (little-endian 32-bit), the cumulative
lengths of its segments (from 0), positions that start anew with each segment, and the documents.

Defined cases: a null text is an empty text and so a single end id; repeated rows are packed each; an
empty table gives an empty result; other columns are ignored. A sequence is named by the first of its
pieces, (doc_id, start).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.durable import in_batches
from quernel.llm.tokens import default_vocabulary, document_ids


@dataclass(frozen=True)
class TokenOutputParams:
    sequence: int = 1024
    end_id: int = 0
    pad_id: int = 0
    #: Tokens that a task packs together; its memory is a small multiple.
    block_tokens: int = 4_000_000


class RoomTree:
    """Amounts of room 0..size, with how many open sequences have each. Finds the least that is enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, room: int) -> int:
        """The least amount of at least ``room`` that an open sequence has, or -1."""
        i = room + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(lengths: np.ndarray, sequence: int) -> list[list[int]]:
    """Sequences as lists of places in ``lengths``."""
    tree = RoomTree(sequence)
    open_: list[list[int]] = [[] for _ in range(sequence + 1)]
    out: list[list[int]] = []
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = sizes[i]
        room = tree.least(n)
        if room < 0:
            room, k = sequence, len(out)
            out.append([])
        else:
            k = open_[room].pop()
            tree.add(room, -1)
        out[k].append(i)
        if room > n:
            open_[room - n].append(k)
            tree.add(room - n, 1)
    return out


_SCHEMA = pa.schema(
    [
        ("first_doc_id", pa.int64()), ("first_start", pa.int64()), ("n_tokens", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())),
        ("input_ids", pa.binary()), ("position_ids", pa.binary()),
    ]
)
_DDL = (
    "first_doc_id long, first_start long, n_tokens int, doc_ids array<long>, starts array<long>, "
    "cu_seqlens array<int>, input_ids binary, position_ids binary"
)


def _packed(docs: list, ids: np.ndarray, offsets: np.ndarray, p: TokenOutputParams) -> pa.RecordBatch:
    size = np.diff(offsets)
    n = -(-size // p.sequence)
    owner = np.repeat(np.arange(len(size)), n)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * p.sequence
    length = np.minimum(p.sequence, size[owner] - start)
    begin = offsets[owner] + start
    rows = []
    for members in best_fit_decreasing(length, p.sequence):
        row, where = np.full(p.sequence, p.pad_id, "<u4"), np.zeros(p.sequence, "<u4")
        cu, at = [0], 0
        for i in members:
            k = int(length[i])
            row[at : at + k], where[at : at + k] = ids[begin[i] : begin[i] + k], np.arange(k)
            at += k
            cu.append(at)
        names = [docs[owner[i]] for i in members]
        begins = [int(start[i]) for i in members]
        rows.append((names[0], begins[0], at, names, begins, cu, row.tobytes(), where.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def packed_sequences(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    vocabulary: str | None = None,
    params: TokenOutputParams = TokenOutputParams(),
) -> DataFrame:
    """One row per packed sequence, ready to be written as a binary table."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(i) for _, i, _ in held)])
            offsets = np.concatenate([[0], *(o[1:] + b for (_, _, o), b in zip(held, base))])
            return _packed([d for ds, _, _ in held for d in ds], np.concatenate([i for _, i, _ in held]), offsets, params)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, offsets in document_ids(batch.column(1), vocabulary, params.end_id):
                held.append((names[first : first + len(offsets) - 1], ids, offsets))
                tokens += len(ids)
                if tokens >= params.block_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    slim = in_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, _DDL)


def write_packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the packed sequences as a table of id matrices in ``path`` and gives that table; Spark's committer takes
    care of lost executors."""
    made = packed_sequences(docs, **options)
    made.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def sequence_digests(sequences: DataFrame) -> DataFrame:
    """The sequences with checksums in place of their ids and positions, and how many places are padding."""
    return sequences.select(
        "first_doc_id", "first_start", "n_tokens", (F.octet_length("input_ids") / 4 - F.col("n_tokens")).cast("int").alias("padding"),
        "doc_ids", "starts", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"),
    )
