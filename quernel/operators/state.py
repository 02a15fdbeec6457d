"""Keyed state as tables: upserts, work queue, coverage ledger, source registry.

State is a DataFrame keyed by its natural key. A batch of changes is folded with ``merge``: the changes
of a key are applied in their order by one aggregation over the ordered list of that key's changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import text as X

RETRY_CAP = 3


def latest(log: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key; the order is total if ``by`` is."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*by))
    return log.groupBy(*keys).agg(last.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upsert(state: DataFrame, changes: DataFrame, key: str, sticky: dict[str, str] | None = None) -> DataFrame:
    """``changes`` over ``state`` by key. ``sticky`` names columns that keep the old value where the
    condition (SQL over ``old`` and ``new``) holds."""
    columns = [c for c in state.columns if c != key]
    o, n = state.alias("old"), changes.alias("new")
    joined = o.join(n, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    new = F.col(f"new.{key}").isNotNull()

    def pick(c: str) -> Column:
        take = new
        if sticky and c in sticky:
            take = new & ~F.coalesce(F.expr(sticky[c]), F.lit(False))
        return F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return joined.select(F.coalesce(f"new.{key}", f"old.{key}").alias(key), *(pick(c) for c in columns))


def reconcile(stored: DataFrame, seen: DataFrame, key: str = "path", compare: tuple[str, ...] = ("mtime", "size")) -> DataFrame:
    """What changed since the stored state: (key, change) with added, updated, removed or same."""
    o, n = stored.alias("o"), seen.alias("n")
    same = None
    for c in compare:
        eq = F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        same = eq if same is None else same & eq
    change = (
        F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").when(same, "same").otherwise("updated")
    )
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"))


def queue_state(log: DataFrame, cap: int = RETRY_CAP) -> DataFrame:
    """The queue after a log of (owner, target, at, seq, op): op is enqueue, complete, fail or revive.

    Enqueuing a done item starts it anew, and leaves a dead one dead; a failure counts up and the last
    allowed one parks the item; only a dead item can be revived. Operations on an unknown item do nothing.
    """
    steps = F.array_sort(F.collect_list(F.struct("at", "seq", "op")))
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("enqueued"))

    def step(s: Column, e: Column) -> Column:
        known, op = s["state"].isNotNull(), e["op"]
        tried = s["attempts"] + 1
        state = (
            F.when(op == "enqueue", F.when(s["state"] == "dead", "dead").otherwise("pending"))
            .when(known & (op == "complete"), F.lit("done"))
            .when(known & (op == "fail"), F.when(tried >= cap, "dead").otherwise(s["state"]))
            .when((op == "revive") & (s["state"] == "dead"), "pending")
            .otherwise(s["state"])
        )
        attempts = (
            F.when((op == "enqueue") & (s["state"] == "done"), 0)
            .when(known & (op == "fail"), tried)
            .when((op == "revive") & (s["state"] == "dead"), 0)
            .otherwise(s["attempts"])
        )
        first = F.when(~known & (op == "enqueue"), e["at"]).otherwise(s["enqueued"])
        return F.struct(state.alias("state"), attempts.alias("attempts"), first.alias("enqueued"))

    folded = log.groupBy("owner", "target").agg(F.aggregate(steps, start, step).alias("s"))
    return folded.select("owner", "target", "s.state", "s.attempts", "s.enqueued").where("state is not null")


def queue_depth(queue: DataFrame, now: Column) -> DataFrame:
    """Per owner: items that wait, seconds since the first of them came, items parked."""
    waits = F.col("state") == "pending"
    age = now.cast("long") - F.min(F.when(waits, F.col("enqueued"))).cast("long")
    return queue.groupBy("owner").agg(
        F.count_if(waits).alias("depth"), F.greatest(F.lit(0), F.coalesce(age, F.lit(0))).alias("oldest_s"), F.count_if(F.col("state") == "dead").alias("parked")
    )


def drain_page(queue: DataFrame, cursor: int, cap: int, id_column: str = "id") -> DataFrame:
    """The next items after the cursor, going round once to the start."""
    turn = (F.col(id_column) <= cursor).cast("int")
    return queue.where("state = 'pending'").orderBy(turn, id_column).limit(cap)


def ledger_pending(targets: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """(target, reason): never, stale, retry, skipped, changed or current."""
    l = ledger.select("target", F.col("version").alias("lv"), "outcome", "input_key", "output_key")
    joined = targets.join(l, "target", "left")
    matches = F.col("key").isNotNull() & ((F.col("key") == F.col("input_key")) | (F.col("key") == F.col("output_key")))
    reason = (
        F.when(F.col("lv").isNull(), "never")
        .when(F.col("lv") != version, "stale")
        .when(F.col("outcome") == "failed", "retry")
        .when(F.col("outcome") == "skipped", "skipped")
        .when(F.coalesce(matches, F.lit(False)), "current")
        .otherwise("changed")
    )
    return joined.select("target", reason.alias("reason"))


def ledger_stats(ledger: DataFrame) -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return ledger.groupBy("stage", "version").agg(count("done"), count("skipped"), count("failed"), F.min("at").alias("oldest"), F.max("at").alias("newest"))


def coverage(reasons: DataFrame) -> DataFrame:
    """(eligible, current, ratio): one if nothing is eligible."""
    n, c = F.count("*"), F.count_if(F.col("reason") == "current")
    return reasons.agg(n.alias("eligible"), c.alias("current"), F.coalesce(F.try_divide(c, n), F.lit(1.0)).alias("ratio"))


def registry(log: DataFrame) -> DataFrame:
    """Sources after a log of (id, kind, hash, cursor, yield, at, seq): first and last seen, the last hash
    and cursor, and all that they yielded. Immutable sources need a hash and growing ones a cursor."""
    valid = F.when(F.col("kind") == "immutable", F.col("hash").isNotNull()).otherwise(F.col("cursor").isNotNull())
    order = F.struct("at", "seq")
    return log.where(valid).groupBy("id").agg(
        F.max_by("kind", order).alias("kind"), F.max_by("hash", order).alias("hash"), F.max_by("cursor", order).alias("cursor"),
        F.sum("yield").alias("yield"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
    )


def streaks(log: DataFrame, job: str, order: list[str], ok: str) -> DataFrame:
    """Each run with the failures in a row up to it, and the rung they reach."""
    w = Window.partitionBy(job).orderBy(*order)
    island = F.sum(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(job, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rung = F.when(F.col("failures") >= 8, "stopped").when(F.col("failures") >= 5, "paused").when(F.col("failures") >= 3, "throttled").otherwise("healthy")
    return log.withColumn("_island", island).withColumn("failures", n.cast("long")).withColumn("rung", rung).drop("_island")


def ledger_rebuild(ledger: DataFrame, stamped: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(the ledger with one stage's rows made anew from what notes carry, one row of what was dropped and recovered).

    ``stamped`` is (target, version, output_key, at) of the notes that bear a stage's stamp; of several for a target the
    newest counts. A recovered row is done, and its input is not known. The other stages stay as they are.
    """
    newest = F.max_by(F.struct("version", "output_key", "at"), F.struct("at", "version", "output_key"))
    found = stamped.where(F.coalesce("target", F.lit("")) != "").groupBy("target").agg(newest.alias("s"))
    rows = found.select(F.lit(stage).alias("stage"), "target", "s.version", F.lit("").alias("input_key"), "s.output_key", F.lit("done").alias("outcome"), "s.at")
    columns = rows.columns
    kept = ledger.where(~F.col("stage").eqNullSafe(F.lit(stage))).select(columns)
    dropped = ledger.agg(F.count_if(F.col("stage").eqNullSafe(F.lit(stage))).alias("dropped"))
    return kept.unionByName(rows), dropped.join(rows.agg(F.count("*").alias("recovered")))


def sources_rebuild(found: DataFrame, sidecar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, sources that cannot be recovered) from what the corpus says of its sources and a sidecar of the rest.

    ``found`` is (source, hash, version, memories) of the notes' provenance: a source that is no identity is passed
    over, one without a hash cannot be recovered. ``sidecar`` is (source, kind, hash, cursor, version, yield) of those
    that gave nothing and of those that grow; it speaks last.
    """
    known = found.withColumn("id", X.source_identity(F.col("source"))).where("id IS NOT NULL")
    hashed = F.coalesce("hash", F.lit("")) != ""
    corpus = known.where(hashed).groupBy("id").agg(F.max("hash").alias("hash"), F.max("version").alias("version"), F.sum("memories").alias("yield"))
    corpus = corpus.select("id", F.lit("immutable").alias("kind"), "hash", F.lit(None).cast("long").alias("cursor"), "version", "yield", F.lit(0).alias("seq"))
    rest = sidecar.select(X.source_identity(F.col("source")).alias("id"), "kind", "hash", F.col("cursor").cast("long").alias("cursor"), "version", "yield", F.lit(1).alias("seq")).where("id IS NOT NULL")
    valid = F.when(F.col("kind") == "immutable", F.coalesce("hash", F.lit("")) != "").otherwise(F.col("cursor").isNotNull())
    every = corpus.unionByName(rest).where(valid)
    last = F.max_by(F.struct("kind", "hash", "cursor", "version"), F.struct("seq", "version", "hash", "cursor"))
    table = every.groupBy("id").agg(last.alias("r"), F.sum("yield").alias("yield")).select("id", "r.*", "yield")
    lost = known.where(~hashed).select("id").distinct().join(table.select("id"), "id", "left_anti")
    return table, lost
