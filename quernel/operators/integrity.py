"""Joins that check a corpus against itself, and small reports on what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.loops import held


def supersede_findings(claims: DataFrame, notes: DataFrame) -> DataFrame:
    """(new, old, finding): claims (new, old) whose old note is missing or still active. ``notes`` is (note, status)."""
    joined = claims.join(notes.select(F.col("note").alias("old"), "status"), "old", "left")
    finding = F.when(F.col("status").isNull(), "missing").when(F.col("status") == "active", "still active")
    return joined.select("new", "old", finding.alias("finding")).where("finding is not null")


def unclaimed(claims: DataFrame, notes: DataFrame) -> DataFrame:
    """Superseded notes that nothing claims to supersede."""
    return notes.where("status = 'superseded'").select("note").join(claims.select(F.col("old").alias("note")), "note", "left_anti")


def repaired_targets(targets: DataFrame, names: DataFrame) -> DataFrame:
    """(target, name): the only name that a target equals but for case; ambiguous ones stay open."""
    by_case = names.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("name"), F.count_distinct("name").alias("_n"))
    return targets.select("target").distinct().join(by_case.where("_n = 1"), F.lower("target") == F.col("_k")).where("target <> name").select("target", "name")


def shared_source(notes: DataFrame, key: str, source: str) -> DataFrame:
    """(key, twin): notes whose source an earlier note has too."""
    first = notes.groupBy(source).agg(F.min(key).alias("twin"), F.count("*").alias("_n")).where("_n > 1")
    return notes.join(first, source).where(F.col(key) > F.col("twin")).select(key, "twin")


def provenance(notes: DataFrame, source: str, key: str, by: str) -> DataFrame:
    """Per source its number of notes and the latest one."""
    return notes.groupBy(source).agg(F.count("*").alias("n"), F.max_by(key, by).alias("latest"))


def neighbours(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, incoming, outgoing): edges (source, target) whose target is the note's path or its name, and its own."""
    into = edges.join(notes.select("path", F.col("path").alias("target")), "target").unionByName(edges.join(notes.select("path", F.col("stem").alias("target")), "target"))
    came = into.groupBy("path").agg(F.count_distinct("source").alias("incoming"))
    went = edges.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("outgoing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return notes.select("path").join(came, "path", "left").join(went, "path", "left").select("path", zero("incoming"), zero("outgoing"))


def connectivity(notes: DataFrame, edges: DataFrame, generated: Column) -> DataFrame:
    """(notes, connected, share, generated): notes with a link of their own that no stage made."""
    own = edges.where(~generated).select(F.col("source").alias("path")).distinct().withColumn("_c", F.lit(1))
    made = edges.agg(F.count_if(generated).alias("generated"))
    return notes.join(own, "path", "left").agg(F.count("*").alias("notes"), F.count("_c").alias("connected"), F.avg(F.coalesce("_c", F.lit(0))).alias("share")).join(made)


def without(log: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """A ledger without the rows whose keys are to be forgotten."""
    return log.join(gone.select(*keys).distinct(), keys, "left_anti")


def _seconds(t: Column) -> Column:
    return t.cast("timestamp").cast("long")


def job_due(last: Column, at: Column, now: Column, lookback_s: int) -> Column:
    """due if it never ran or its time lies between the last run and now; missed if that is past the lookback."""
    age = _seconds(now) - _seconds(at)
    pending = last.isNull() | (last < at)
    return F.when(last.isNull(), "due").when(pending & (age >= 0) & (age <= lookback_s), "due").when(pending & (age > lookback_s), "missed").otherwise("waiting")


def cooled(last: Column, now: Column, hours: int) -> Column:
    return last.isNull() | (_seconds(now) - _seconds(last) >= hours * 3600)


def route(jobs: DataFrame, audits: DataFrame, version: str, least_n: int = 25, least_rate: float = 0.9) -> DataFrame:
    """(job, tier, why): the strong tier unless a current audit of enough samples agrees often enough."""
    why = (
        F.when(F.col("pinned"), "pinned").when(F.col("version").isNull(), "no audit").when(F.col("version") != version, "stale")
        .when((F.col("sampled") < least_n) | (F.col("rate") < least_rate), "below bar").otherwise("qualified")
    )
    return jobs.join(audits, "job", "left").select("job", F.when(why == "qualified", "cheap").otherwise("strong").alias("tier"), why.alias("why"))


def agreement(samples: DataFrame, least_n: int = 25, least_rate: float = 0.9) -> DataFrame:
    """Per job the share of usable samples on which both tiers agree, and whether it meets the bar."""
    usable = samples.where("cheap is not null and strong is not null")
    out = usable.groupBy("job").agg(F.count("*").alias("sampled"), F.avg((F.col("cheap") == F.col("strong")).cast("double")).alias("rate"))
    return out.withColumn("meets", (F.col("sampled") >= least_n) & (F.col("rate") >= least_rate))


def regressions(scores: DataFrame, baseline: DataFrame, slack: float = 3.0) -> DataFrame:
    """(axis, score, baseline, red): axes that fell more than ``slack`` below their baseline."""
    joined = scores.join(baseline.select("axis", F.col("score").alias("baseline")), "axis", "left")
    return joined.select("axis", "score", "baseline", F.coalesce(F.col("score") < F.col("baseline") - slack, F.lit(False)).alias("red"))


def term_idf(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(term, df, idf): ln(1 + N / (1 + df))."""
    n = docs.count()
    df = docs.select(key, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(1 + F.lit(n) / (1 + F.col("df"))))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by a hash of key and seed, in order of key."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n).orderBy(key)


def best_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(question, best_rank): the best rank of an expected item over all queries of a question."""
    hit = ranked.join(gold, ["question", "item"]).groupBy("question").agg(F.min("rank").alias("best_rank"))
    return gold.select("question").distinct().join(hit, "question", "left")


def merge_order(plans: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((plan, level), plans on or behind a cycle): a plan comes after all that it needs; level by level, by name within.

    Each round takes the plans whose needs are all taken; it ends when a round takes none.
    """
    (left, n), level = held(plans.select("plan").distinct()), 0
    taken = plans.select("plan", F.lit(0).alias("level")).limit(0)
    while n:
        open_ = needs.join(left.select(F.col("plan").alias("needs")), "needs", "left_semi").select("plan").distinct()
        ready, got = held(left.join(open_, "plan", "left_anti"))
        if not got:
            break
        taken, level = taken.unionByName(ready.select("plan", F.lit(level).alias("level"))), level + 1
        left, n = held(left.join(ready, "plan", "left_anti"))
    return taken, left


def over_fetch(scored: DataFrame, by: str, score: str, key: str, n: int = 200) -> DataFrame:
    """The rows that go into a second ranking: the best ``n`` of each query."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), key)
    return scored.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")
