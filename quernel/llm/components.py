"""Connected components of an edge table, without bringing edges or components to one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.durable import Rounds, tidy


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.setdefault(r, r)) != r:
            r = p
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as a forest: each vertex with its root, a row per vertex at most. Batches of edges are
    reduced one by one, so memory is bounded by a batch."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        a = np.array([p[0] for p in pairs], np.int64)
        b = np.array([p[1] for p in pairs], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of all vertices of ``edges`` (a long, b long); the root is the smallest of them.

    Each round every vertex goes to the first of itself and its neighbours in a pseudo-random order of
    that round, and on to where that one went; edges are renamed and those inside a component dropped,
    until none are left. The order makes paths to a local first short whatever the ids, so a long chain
    of edges shrinks by a factor each round, as any other graph does.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.cut(edges.select("a", "b").mapInArrow(tidy(_local_forest), "a long, b long").distinct())
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        up = both.groupBy(F.col("a").alias("v")).agg(F.min(place("b")).alias("_first"))
        up = rounds.cut(up.select("v", F.least(place("v"), "_first")["v"].alias("p")))
        for _ in range(2):
            on = up.select(F.col("v").alias("p"), F.col("p").alias("_to"))
            up = up.join(on, "p").select("v", F.col("_to").alias("p"))
        up = rounds.cut(up)
        renamed = (
            edges.join(up.select(F.col("v").alias("a"), F.col("p").alias("_a")), "a")
            .join(up.select(F.col("v").alias("b"), F.col("p").alias("_b")), "b")
            .select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        )
        renamed = renamed.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = rounds.cut(renamed)
        if labels is None:
            labels = up.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(up.withColumnRenamed("v", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = rounds.cut(labels)
        rounds.forget(2)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = labels.groupBy("root").agg(F.min("node").alias("_least"))
    return rounds.cut(labels.join(least, "root").select("node", F.col("_least").alias("root")))
