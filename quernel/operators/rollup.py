"""Usage rollups: cumulative captures, deltas by window, counters, budgets, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hours of a window. Windows are aligned to midnight UTC of 1970-01-01.
WINDOW_HOURS = 5


def latest_totals(events: DataFrame, by: list[str]) -> DataFrame:
    """Sums by ``by`` of the last capture of each (session, model); a capture is a running total."""
    last = events.groupBy("session", "model").agg(F.max_by(F.struct("cost", *[c for c in by if c != "model"]), F.struct("ts", "event_id")).alias("r"))
    flat = last.select("session", "model", "r.*")
    return flat.groupBy(*by).agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))


def deltas(events: DataFrame) -> DataFrame:
    """Each capture with what it adds to the one before of its (session, model); those that add nothing go."""
    w = Window.partitionBy("session", "model").orderBy("ts", "event_id")
    return events.withColumn("delta", F.col("cost") - F.coalesce(F.lag("cost").over(w), F.lit(0.0))).where("delta <> 0")


def by_window(events: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    """Cost by tumbling window, each delta in the window of its own capture."""
    start = F.window("ts", f"{hours} hours")["start"]
    return deltas(events).groupBy(start.alias("window_start")).agg(F.sum("delta").alias("cost"), F.count("*").alias("n"))


def sessions(events: DataFrame, user: str, gap: str) -> DataFrame:
    """Sessions of a user that a pause of ``gap`` ends."""
    s = events.groupBy(user, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return s.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "value")


def heat(hits: DataFrame, total_days: int) -> DataFrame:
    """(item, hits, days, verdict): cold items are demoted after ten days, warm ones promoted from three
    hits on two days."""
    counts = hits.groupBy("item").agg(F.count("hit").alias("hits"), F.count_distinct(F.when(F.col("hit"), F.to_date("ts"))).alias("days"))
    verdict = F.when((F.col("hits") == 0) & F.lit(total_days >= 10), "demote").when((F.col("hits") >= 3) & (F.col("days") >= 2), "promote").otherwise("keep")
    return counts.withColumn("verdict", verdict)


def pack_budget(items: DataFrame, group: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Items that a budget of tokens takes, in order; one that does not fit is passed over, not the end.

    The fold is over one group's ordered items, so groups have to be bounded (a result page).
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, tokens)))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(s, x):
        fits = s["used"] + x[tokens] <= budget
        return F.struct((s["used"] + F.when(fits, x[tokens]).otherwise(0)).alias("used"), F.concat(s["kept"], F.array(fits)).alias("kept"))

    folded = items.groupBy(group).agg(rows.alias("rows")).withColumn("f", F.aggregate("rows", start, step))
    every = folded.select(group, F.explode(F.arrays_zip("rows", F.col("f.kept").alias("kept"))).alias("z"))
    return every.select(group, *(F.col(f"z.rows.{c}").alias(c) for c in order), F.col("z.kept").alias("kept"))


def health_index(records: DataFrame) -> DataFrame:
    """(axis, score): the passed share of the weights of an axis, in percent, dark checks left out."""
    live = records.where("not dark and pass is not null")
    return live.groupBy("axis").agg((F.sum(F.when(F.col("pass"), F.col("weight"))) * 100 / F.sum("weight")).alias("score"))


def describe(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, nearest-rank 90th percentile and maximum. Equal values are one row before any group comes
    together."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(below), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    at = F.floor((F.col("_all") - 1) * 0.9) + 1
    weight = F.col("_n")
    return ranked.groupBy(*by).agg(
        (F.sum(F.col(value) * weight) / F.sum("_n")).alias("mean"), F.percentile(value, F.lit(0.5), weight).alias("median"), F.percentile(value, F.lit(0.9), weight).alias("p90_interpolated"),
        F.max(value).alias("max"), F.min(F.when(F.col("_upto") >= at, F.col(value))).alias("p90"),
    )
