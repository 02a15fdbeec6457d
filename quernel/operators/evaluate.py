"""Retrieval quality: precision, recall, ranks, paired tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_k(gold: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Per question: hits, p_at_k, r_at_k, first_rank, is_negative.

    ``gold`` is (query_id, expected array), ``ranked`` is (query_id, item, rank). Precision divides by k.
    A question that expects nothing is right when nothing comes back.
    """
    best = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list(F.struct("item", "rank")).alias("top"))
    joined = gold.join(best, "query_id", "left").withColumn("top", F.coalesce("top", F.array()))
    found = F.filter("top", lambda t: F.array_contains("expected", t["item"]))
    joined = joined.withColumn("f", found).withColumn("is_negative", F.size("expected") == 0)
    right = (F.size("top") == 0).cast("double")
    n = F.size("f")
    return joined.select(
        "query_id", n.cast("long").alias("hits"), "is_negative",
        F.when(F.col("is_negative"), right).otherwise(n / F.lit(k)).alias("p_at_k"),
        F.when(F.col("is_negative"), right).otherwise(n / F.size("expected")).alias("r_at_k"),
        F.array_min(F.transform("f", lambda t: t["rank"])).alias("first_rank"),
    )


def scorecard(scores: DataFrame) -> DataFrame:
    """Share of questions with any hit, mean first rank, reciprocal rank, negatives rejected."""
    asked = ~F.col("is_negative")
    return scores.agg(
        F.count_if(asked).alias("scored"), F.count_if(asked & (F.col("hits") > 0)).alias("hit"),
        F.avg(F.when(asked, (F.col("hits") > 0).cast("double"))).alias("r_at_k"), F.avg(F.when(asked, F.col("first_rank"))).alias("mean_first_rank"),
        F.avg(F.when(asked, F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))).alias("mrr"), F.count_if(F.col("is_negative") & (F.col("p_at_k") == 1.0)).alias("rejected"),
    )


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(won, lost, same) of the questions of two runs (query_id, hit)."""
    j = before.select("query_id", F.col("hit").alias("b")).join(after.select("query_id", F.col("hit").alias("a")), "query_id", "full")
    b, a = F.coalesce("b", F.lit(False)), F.coalesce("a", F.lit(False))
    return j.agg(F.count_if(~b & a).alias("won"), F.count_if(b & ~a).alias("lost"), F.count_if(a == b).alias("same"))


def mcnemar_p(won: Column, lost: Column) -> Column:
    """Two-sided exact probability of so uneven a split of the changed questions; 1 if none changed."""
    n, least = (won + lost).cast("double"), F.least(won, lost).cast("long")
    start = F.struct((-n * math.log(2)).alias("log"), F.lit(0.0).alias("sum"))

    # n choose i over 2 ** n as a logarithm, each from the one before, so that many questions do not underflow.
    def add(s: Column, i: Column) -> Column:
        return F.struct((s["log"] + F.ln((n - i) / (i + 1.0))).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), least), start, add)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


#: Runs of a group at most: there are 2 ** RUNS ways to deal them out.
RUNS = 20


def _deals(groups: DataFrame, group: str) -> DataFrame:
    """A row for each way to choose some of ``pool``, with how many and their sum; groups with too many runs have none."""
    ways = F.expr(f"IF(size(pool) <= {RUNS}, sequence(0, shiftleft(1, size(pool)) - 1), NULL)")
    rows = groups.withColumn("mask", F.explode(ways))
    chosen = F.expr("aggregate(sequence(0, size(pool) - 1), 0.0D, (s, i) -> s + if(bit_get(mask, i) = 1, pool[i], 0.0D))")
    return rows.withColumns({"many": F.bit_count("mask"), "chosen": F.when(F.size("pool") > 0, chosen).otherwise(0.0)})


def permutation_tests(runs: DataFrame, group: str, arm: str, value: str) -> DataFrame:
    """(group, p): the share of all ways to deal a group's runs out to two arms (true and false) of the same sizes whose
    means differ at least as much as they do. Null if an arm has no run or the group more than ``RUNS``."""
    v = F.col(value).cast("double")
    arms = runs.where(v.isNotNull()).groupBy(group).agg(F.collect_list(F.when(F.col(arm), v)).alias("a"), F.collect_list(F.when(~F.col(arm), v)).alias("b"))
    pools = arms.select(group, F.concat("a", "b").alias("pool"), F.size("a").alias("n"), F.size("b").alias("m")).where("n > 0 AND m > 0")
    total = F.expr("aggregate(pool, 0.0D, (s, x) -> s + x)")
    gap = lambda mine: F.abs(mine / F.col("n") - (F.col("total") - mine) / F.col("m"))
    own = F.expr("aggregate(slice(pool, 1, n), 0.0D, (s, x) -> s + x)")
    dealt = _deals(pools.withColumns({"total": total, "own": own}), group).where("many = n")
    p = dealt.groupBy(group).agg(F.avg((gap(F.col("chosen")) >= gap(F.col("own")) - 1e-12).cast("double")).alias("p"))
    return runs.select(group).distinct().join(p, group, "left")


def sign_flip_tests(pairs: DataFrame, group: str, difference: str) -> DataFrame:
    """(group, p): the share of all sign patterns of a group's differences whose sum is at least as far from zero. Null
    if it has more than ``RUNS``, or none."""
    v = F.col(difference).cast("double")
    pools = pairs.where(v.isNotNull()).groupBy(group).agg(F.collect_list(v).alias("pool"), F.sum(v).alias("total"))
    flipped = F.abs(F.col("total") - 2 * F.col("chosen")) >= F.abs("total") - 1e-12
    p = _deals(pools, group).groupBy(group).agg(F.avg(flipped.cast("double")).alias("p"))
    return pairs.select(group).distinct().join(p, group, "left")
