"""Tables of an index after changes to notes."""

from datetime import datetime

from pyspark.sql import functions as F

from quernel.operators import lint, loops, store


def test_tables_lose_notes_and_chunks_are_replaced(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "path string, n int")
    links = spark.createDataFrame([("b", "a"), ("a", "b")], "source string, t string")
    gone = spark.createDataFrame([("b",), ("b",), (None,)], "path string")
    left = store.without_notes({"docs": (docs, "path"), "links": (links, "source")}, gone)
    assert {tuple(r) for r in left["docs"].collect()} == {("a", 1), (None, 3)} and left["links"].columns == links.columns
    assert [tuple(r) for r in left["links"].collect()] == [("a", "b")] and [r["n"] for r in store.lookup(docs, "a").collect()] == [1]
    kind = "k int, i int, c string"
    stored = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z"), (3, 0, "w")], kind)
    notes, built = spark.createDataFrame([(1,), (2,), (4,)], "k int"), spark.createDataFrame([(1, 0, "new"), (4, 0, "q")], kind)
    assert {tuple(r) for r in store.replace_chunks(stored, notes, built, "k").collect()} == {(1, 0, "new"), (3, 0, "w"), (4, 0, "q")}
    kind = "k int, model string, at int, v array<int>"
    old = spark.createDataFrame([(1, "m", 1, [1]), (1, "n", 1, [2]), (2, "m", 1, [3])], kind)
    new = spark.createDataFrame([(1, "m", 2, [9]), (1, "m", 3, [8]), (5, "m", 1, None)], kind)
    assert sorted((r.k, r.model, r.v) for r in store.replace_vectors(old, new, "k", "model").collect()) == [(1, "m", [8]), (1, "n", [2]), (2, "m", [3]), (5, "m", None)]


def test_histories_by_age_and_schema(spark):
    lines = ['{"ts": "2025-01-30T00:00:00Z"}', '{"ts": "2025-01-30T00:00:00+02:00"}', '{"ts": "2025-01-29T23:59:59"}', '{"ts": 5}', "{", "", None, '{"x": 1}', "[]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    kept = store.pruned_history(df, F.lit(datetime(2025, 2, 9)), 10)
    assert {r["i"] for r in kept.collect()} == {0}
    front = spark.createDataFrame([("b: 1\\na: 2\\nz: 3".replace("\\n", chr(10)), "s", "s", "Bad Arc"), ("a: 1", None, "s", None), (None, "", "s", "ok"), ("a: 1", "t", "s", "on")], "f string, slug string, name string, arc string")
    got = [r[0] for r in front.select(lint.schema_findings(F.col("f"), ("a", "b"), F.col("slug"), F.col("name"), F.col("arc"), ("on",))).collect()]
    assert got == [["fields out of order", "unknown key z", "arc is not kebab"], [], ["arc is unknown"], ["slug is not the file name"]]


def test_old_tables_are_let_go(spark):
    loops.release()
    frames = [loops.kept(spark.range(i + 1)) for i in range(loops.MOST_KEPT + 3)]
    assert [f.is_cached for f in frames] == [False] * 3 + [True] * loops.MOST_KEPT and frames[0].count() == 1
    loops.release()
    assert not any(f.is_cached for f in frames)
