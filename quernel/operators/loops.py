"""Tables of loops."""

from __future__ import annotations

import tempfile
import uuid
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or where that is unset and all runs in
    one process in a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quernel-")
    return f"{named}/{uuid.uuid4().hex}"


#: Tables that are kept at once: those of the last few queries. What is dropped is worked out again if it is still read.
MOST_KEPT = 12
_kept: deque[DataFrame] = deque()


def kept(df: DataFrame) -> DataFrame:
    """``df``, kept in memory and on disk while it is among the last ``MOST_KEPT``, so that a long session doesn't fill up."""
    df = df.persist()
    _kept.append(df)
    release(MOST_KEPT)
    return df


def release(keep: int = 0) -> None:
    """Lets go of all kept tables but the last ``keep``."""
    while len(_kept) > keep:
        old = _kept.popleft()
        if old.sparkSession.sparkContext._jsc is not None:  # else its session has ended
            old.unpersist()


def held(df: DataFrame, broadcast_rows: int = 100_000) -> tuple[DataFrame, int]:
    """(the table, cut off from its plan, its rows). Estimates that joins multiply would grow with each round, so a
    table is either small enough to broadcast, by its real count of narrow rows, or joined by sorting.

    It is checkpointed where the session names a folder for that, else kept in memory and on disk.
    """
    context = df.sparkSession.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    df = df.checkpoint() if named else df.persist()
    n = df.count()
    return (F.broadcast(df) if n <= broadcast_rows else df.hint("merge")), n
