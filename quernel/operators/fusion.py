"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The constant of the ranks, and how deep each list counts.
RRF_K = 60
DEPTH = 50


def rrf(*arms: DataFrame, key: str, k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """(query_id, key, score): the sum of 1 / (k + rank) over the lists (query_id, key, rank)."""
    lists = (a.where(F.col("rank") <= depth).select("query_id", key, "rank") for a in arms)
    every = reduce(DataFrame.unionByName, lists)
    return every.groupBy("query_id", key).agg(F.sum(1 / (F.col("rank") + k)).alias("score"))
