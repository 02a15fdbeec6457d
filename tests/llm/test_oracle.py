"""Queries whose SQL DuckDB can run give its rows."""

import duckdb
import pytest

from quernel.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).fetchdf()
    got = registry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda frame: sorted(map(tuple, frame[columns].itertuples(index=False)))
    assert as_rows(got) == as_rows(want)


def test_quality_rules_equal_sql_on_odd_texts(spark, tmp_path):
    texts = [None, "", " \t\n", "one", "a b c a b c a b c", "x # x\n\n*x*\nx # x", "é ü ñ\x0bb\x0cc", "w " * 60, "a b c d\n" * 20,
             "long" * 30 + " y" * 3]
    rows = [(i, t, h) for i, t in enumerate(texts + texts[:3]) for h in (None, "h", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["op9_quality_rules"]).fetchall()
    names = [c[0] for c in con.description]
    got = registry.op9_quality_rules(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
