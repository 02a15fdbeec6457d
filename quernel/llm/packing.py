"""Shortest-pack-first packing over the length histogram.

A document is its token ids and an end id. It is cut into whole sequences and a rest; the histogram of
the lengths (at most ``sequence`` rows) is packed on the driver: lengths from the longest, each into
the shortest pack that has room, counts at a time. The packing patterns then go back to the pieces by
rank: the pieces of one length are ranked, and blocks of ranks belong to the slots of a pattern.

Ranks are taken within (length, bucket of the id and the partition), with the buckets' counts summed
before, so neither a length that a third of all pieces have nor a row that is repeated as often is one task.

Defined cases: a null text is an empty text and so a single end id; very long texts are cut into as
many pieces as they need; repeated rows are packed each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.durable import cut, in_batches, tidy
from quernel.llm.tokens import default_vocabulary, document_ids


@dataclass(frozen=True)
class PackingParams:
    sequence: int = 1024
    end_id: int = 0
    #: Pieces that are ranked together, about.
    rank_bucket: int = 100_000


@dataclass(frozen=True)
class Slots:
    """For each length the blocks of ranks: first rank, first sequence, copies of the length in the
    pattern, and the offset of the first copy. Sorted by (length, first rank)."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray


def pack_histogram(counts: dict[int, int], sequence: int) -> Slots:
    """Packs the histogram: {length: pieces}."""
    # Open packs by their filling: filling -> list of [lengths so far, number of such packs].
    levels: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fill = min((f for f in levels if f + length <= sequence), default=None)
            if fill is None:
                # As many copies of this length as one pack holds.
                many = min(left, sequence // length)
                levels.setdefault(many * length, []).append(((length,) * many, left // many))
                left -= many * (left // many)
                continue
            pattern, n = levels[fill].pop()
            if not levels[fill]:
                del levels[fill]
            # Into each of these packs as many copies as fit, if there are enough for all of them.
            many = max(1, min((sequence - fill) // length, left // n))
            used = min(n, left // many)
            if used < n:
                levels.setdefault(fill, []).append((pattern, n - used))
            levels.setdefault(fill + many * length, []).append((pattern + (length,) * many, used))
            left -= used * many
    rows, taken, first = [], dict.fromkeys(counts, 0), 0
    for fill in sorted(levels, reverse=True):
        for pattern, n in levels[fill]:
            at = 0
            for length in dict.fromkeys(pattern):
                copies = pattern.count(length)
                rows.append((length, taken[length], first, copies, at))
                taken[length] += n * copies
                at += length * copies
            first += n
    assert taken == counts
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Slots(*columns)


def place(slots: Slots, length: np.ndarray, rank: np.ndarray, sequence: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces of given length and rank."""
    # Rank and length as one key; the ranks of a length start at 0, so its blocks come first.
    span = int(max(rank.max(initial=0), slots.rank.max(initial=0))) + 1
    at = np.searchsorted(slots.length * span + slots.rank, length * span + rank, "right") - 1
    inside = rank - slots.rank[at]
    copies = slots.copies[at]
    return slots.sequence[at] + inside // copies, slots.offset[at] + inside % copies * length


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    vocabulary: str | None = None,
    params: PackingParams = PackingParams(),
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document; with ``with_ids`` also their ids, little-endian 32-bit."""
    vocabulary = vocabulary or default_vocabulary()
    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, offsets in document_ids(batch.column(1), vocabulary, params.end_id):
                size = np.diff(offsets)
                n = -(-size // params.sequence)
                owner = np.repeat(np.arange(len(size)), n)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * params.sequence
                length = np.minimum(params.sequence, size[owner] - start)
                data = memoryview(ids.astype("<u4").tobytes())
                begin = (offsets[owner] + start) * 4
                parts = [data[b : b + 4 * k] for b, k in zip(begin.tolist(), length.tolist())]
                columns = [
                    doc_ids.slice(first, len(size)).take(pa.array(owner)),
                    pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(size[owner]),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(map(bytes, parts), pa.binary())] * with_ids)], names=names)

    slim = in_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(run), _PIECES + ", ids binary" * with_ids)


def pack(cut_pieces: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; read once for the histogram, so give a cut table."""
    counts = {r[0]: r[1] for r in cut_pieces.groupBy("length").count().collect()}  # `sequence` rows at most
    shared = cut_pieces.sparkSession.sparkContext.broadcast(pack_histogram(counts, params.sequence))
    buckets = max(1, sum(counts.values()) // params.rank_bucket, max(counts.values(), default=0) // params.rank_bucket)
    # Copies of one row fall into different buckets by the partition of the cut table in which they stand.
    spread = max(16, buckets)
    keyed = cut_pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", F.spark_partition_id()), F.lit(spread)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("length", "_bucket")
        .agg(F.count("*").alias("_n"))
        .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        keyed.withColumn("_r", F.row_number().over(inside))
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_r") - 1)
        .select(*cut_pieces.columns, "_rank")
    )
    names = [*cut_pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            where = place(shared.value, length, rank, params.sequence)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, where)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    return ranked.mapInArrow(tidy(run), f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    vocabulary: str | None = None,
    params: PackingParams = PackingParams(),
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it comes from and where it is packed."""
    return pack(cut(pieces(docs, text, id_column, vocabulary, params, with_ids)), params)
