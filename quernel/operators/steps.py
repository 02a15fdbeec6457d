"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns as a step of its own. The optimizer puts an expression where it is read, and in a lambda
    that is once an element; what is generated stays apart."""
    names = list(columns)
    rows = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return rows.select(*df.columns, *(F.col("_once")[n].alias(n) for n in names))
