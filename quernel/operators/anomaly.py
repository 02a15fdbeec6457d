"""A breaker for stages whose counts leave what is usual for them. What trips it never becomes part of the usual."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: Normal cycles that are usual, how many there have to be, and how much above their mean is too much.
WINDOW, LEAST, FACTOR = 8, 3, 3.0
RESULT = "n long, baseline double, threshold double, tripped boolean"


def check(history: list[int], n: int) -> tuple[list[int], float | None, float | None, bool]:
    """(history after this cycle, mean of the history before, threshold, tripped). A count of zero never trips, nor
    does any while there is too little history."""
    baseline = sum(history) / len(history) if history else None
    threshold = baseline * FACTOR if history else None
    tripped = n != 0 and len(history) >= LEAST and n > threshold
    return (history if tripped else [*history, n][-WINDOW:]), baseline, threshold, tripped


def stage_anomalies(counts: DataFrame, stage: str, cycle: str, n: str) -> DataFrame:
    """(stage, cycle, n, baseline, threshold, tripped) of each count in the order of its stage's cycles.

    A task goes through its stages' sorted rows and holds ``WINDOW`` numbers, however long a stage's history is. Cycles
    of a stage are unique; a null count is zero.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, i, s, c or 0) for b in batches for i, (s, c) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())))
        held: list = []
        last = None
        for _, group in groupby(rows, lambda r: r[2]):
            history: list[int] = []
            for batch, i, _, count in group:
                if last is not None and batch is not last:
                    yield made(last, held)
                    held = []
                last = batch
                history, *verdict = check(history, count)
                held.append((count, *verdict))
        if last is not None:
            yield made(last, held)

    def made(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.bool_())
        columns = [pa.array(c, k) for c, k in zip(zip(*held), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[stage, cycle, "n", "baseline", "threshold", "tripped"])

    types = [counts.select(c).schema[0].dataType.simpleString() for c in (stage, cycle)]
    rows = counts.select(stage, cycle, counts[n].cast("long").alias("n")).repartition(stage).sortWithinPartitions(stage, cycle)
    return rows.mapInArrow(fold, f"{stage} {types[0]}, {cycle} {types[1]}, {RESULT}")
