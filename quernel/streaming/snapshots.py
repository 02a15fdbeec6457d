"""The snapshot of notes kept up to date by a stream of saved notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quernel.operators import snapshots


def follow(saved: DataFrame, folder: str, checkpoint: str, buckets: int = snapshots.BUCKETS) -> StreamingQuery:
    """Merges each batch of saved notes (path, stem, modified, raw) into the snapshot. A batch that is delivered again
    changes nothing, and one with an older state of a note does not bring that back."""

    def merge(batch: DataFrame, _: int) -> None:
        snapshots.rebuild(batch, folder, whole=False, buckets=buckets)

    return saved.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
