"""Tables of an index that hang on notes: removal of notes from all of them, chunks of a note replaced whole, histories kept
for a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: days that a line of a history is kept.
RETENTION_DAYS = 90


def without_notes(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table, given with its column of paths, without the rows of notes that are ``gone`` (path)."""
    paths = gone.select("path").where("path IS NOT NULL").distinct()
    return {name: t.join(paths.withColumnRenamed("path", c), c, "left_anti").select(t.columns) for name, (t, c) in tables.items()}


def lookup(docs: DataFrame, path: str) -> DataFrame:
    """The rows of one note; the path goes down to the scan as a filter."""
    return docs.where(F.col("path") == path)


def replace_chunks(stored: DataFrame, notes: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """The stored chunks with those of ``notes`` (key) replaced by what was ``built`` for them. A note that has fewer chunks
    than before loses the rest, one that has none loses all."""
    return stored.join(notes.select(key).distinct(), key, "left_anti").select(stored.columns).unionByName(built.select(stored.columns))


def replace_vectors(stored: DataFrame, fresh: DataFrame, key: str, model: str) -> DataFrame:
    """The stored vectors (key, model, ...) with the fresh ones in place of those of the same note and model. Of a note that
    comes twice the last by ``at`` counts."""
    columns = [c for c in stored.columns if c not in (key, model)]
    latest = fresh.groupBy(key, model).agg(F.max_by(F.struct(*columns), "at").alias("_v")).select(key, model, *(f"_v.{c}" for c in columns))
    return stored.join(latest.select(key, model), [key, model], "left_anti").select(stored.columns).unionByName(latest.select(stored.columns))


def history_times(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ``ts``: the time that a JSON line names, in UTC where it names no zone, else null."""
    said = F.try_variant_get(F.try_parse_json(line), "$.ts", "string")
    return lines.withColumn("ts", F.try_to_timestamp(said))


def pruned_history(lines: DataFrame, now: Column, days: int = RETENTION_DAYS, line: str = "line") -> DataFrame:
    """The lines of a history that are younger than ``days``, without blank ones and without those that cannot be read."""
    since = now - F.make_dt_interval(F.lit(days))
    return history_times(lines.where(F.col(line).rlike(r"\S")), line).where(F.col("ts") >= since)
