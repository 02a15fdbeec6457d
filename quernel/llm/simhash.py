"""SimHash near duplicates by anchor-point covering.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its three-word shingles. Anchors are the
2**24 code words of a covering code on 46 of the bits (``golay``): every string has one within the covering radius.
Two fingerprints that differ in at most ``threshold`` bits have a string midway, and its anchor is within the radius plus
half the threshold of both: of one half, rounded down, of the other, rounded up. So each fingerprint is copied to
all anchors within the radius plus either half, about 10 and 61, and those of the first kind meet those of the second.
Copies to all anchors within the radius plus the whole threshold would be 302 a fingerprint and find no more.

Documents of one fingerprint are one vertex, however many they are. Fingerprints of the first kind at an anchor
that has very many are cut into blocks by hash. Links are reduced to forests in the tasks that find them, and components contracted over
tables in the shared folder.

Nulls: a null or wordless text has fingerprint zero and is linked like any other. A null id gets its component's
smallest id like the rest, null if there is none. Repeated ids and rows stay. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quernel.llm import golay
from quernel.llm.components import connected
from quernel.llm.durable import broadcast_if_small, cut, in_batches, tidy


@dataclass(frozen=True)
class SimhashParams:
    n: int = 3
    #: Fingerprints that differ in at most so many bits are linked; at most 3.
    threshold: int = 3
    seed: int = 42
    #: Fingerprints near one anchor from which on they are cut into blocks.
    block: int = 2048

    def __post_init__(self):
        if not 0 <= self.threshold <= 3:
            raise ValueError("threshold is from 0 to 3")


#: Shingles hashed at once.
_STEP = 1 << 15


def fingerprint(text: str | None, p: SimhashParams) -> int:
    """The bits that are one in more than half of the shingles' hashes. The whole text is one sequence of words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < p.n:
        words, size = [b" ".join(words)], 1
    else:
        size = p.n
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _STEP):
        some = zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist())
        hashes = np.array([xxh64_intdigest(joined[s:e], p.seed) for s, e in some], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(starts)).tolist())


def fingerprints(docs: DataFrame, p: SimhashParams = SimhashParams()) -> DataFrame:
    """(doc_id, fp long) of whole texts; ``fp`` has the 64 bits of the fingerprint."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), p) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text")).mapInArrow(tidy(give), f"doc_id {kind}, fp long")


def _anchored(prints: DataFrame, reach: int) -> DataFrame:
    """(anchor, fp) for each fingerprint and each anchor within the covering radius plus ``reach`` bits."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 2048):
                fps = whole[at : at + 2048]
                rows, anchors = golay.anchors(fps & ((1 << 46) - 1), reach)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.astype(np.int32)), pa.array(fps[rows])], names=["anchor", "fp"])

    return prints.select("fp").mapInArrow(tidy(give), "anchor int, fp long")


def links(prints: DataFrame, p: SimhashParams = SimhashParams()) -> DataFrame:
    """(a, b) of different fingerprints (column ``fp``, each once) that differ in at most ``threshold`` bits."""
    near, far = (_anchored(prints, reach) for reach in (p.threshold // 2, p.threshold - p.threshold // 2))
    # Those near a crowded anchor are cut into blocks, and those far go to each.
    crowded = near.groupBy("anchor").count().where(F.col("count") > p.block)
    crowded = broadcast_if_small(cut(crowded.select("anchor", F.ceil(F.col("count") / p.block).cast("int").alias("blocks"))), width=F.lit(8))
    one = F.coalesce("blocks", F.lit(1))
    left = near.join(crowded, "anchor", "left").select("anchor", F.pmod(F.xxhash64("fp"), one).cast("int").alias("block"), F.col("fp").alias("a"))
    right = far.join(crowded, "anchor", "left").select("anchor", F.explode(F.sequence(F.lit(0), one - 1)).alias("block"), F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= p.threshold
    return left.join(right, ["anchor", "block"]).where((F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(docs: DataFrame, p: SimhashParams = SimhashParams()) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id: the smallest id reachable by links)."""
    found = cut(fingerprints(docs, p))
    prints = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(prints, p)).select(F.col("node").alias("fp"), "root")
    prints = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    components = prints.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = prints.join(components, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.join(classes, "fp").select("doc_id", digits, "component_id")
