"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quernel import catalog

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    # A null is None, nan, NaT or NA, as the column's type in pandas has it.
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(shown, r)) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).fetchdf())
