"""The breaker on counts as they arrive: each stage's recent normal cycles are its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernel.operators import anomaly


def stage_anomalies(counts: DataFrame, stage: str, cycle: str, n: str) -> DataFrame:
    """As the batch operator, of a stream. Cycles of a stage come in order from one batch to the next, within one in any."""
    types = [counts.schema[c].dataType.simpleString() for c in (stage, cycle)]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values("cycle")
        found = []
        for c, count in zip(rows["cycle"], rows["n"].fillna(0).astype("int64").tolist()):
            history, *verdict = anomaly.check(history, count)
            found.append((key[0], c, count, *verdict))
        state.update((history,))
        yield pd.DataFrame(found, columns=[stage, cycle, "n", "baseline", "threshold", "tripped"])

    rows = counts.select(counts[stage].alias("stage"), counts[cycle].alias("cycle"), counts[n].cast("long").alias("n"))
    return rows.groupBy("stage").applyInPandasWithState(
        fold, f"{stage} {types[0]}, {cycle} {types[1]}, {anomaly.RESULT}", "history array<long>", "append", GroupStateTimeout.NoTimeout)
