"""Rebuilds touch what changed and nothing else."""

import datetime as dt
import os

from quernel.operators import snapshots
from quernel.streaming.snapshots import follow

SCHEMA = "path string, stem string, modified timestamp, raw string"


def note(i, day, raw):
    return (f"n/{i}.md", f"n{i}", dt.datetime(2025, 1, day), raw)


def files(folder):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def state(spark, folder):
    s = snapshots.read(spark, folder)
    return {r["path"] for r in snapshots.nodes(s).collect()}, {tuple(r) for r in snapshots.edges(s).collect()}


def test_rebuild_touches_what_changed(spark, tmp_path):
    folder = str(tmp_path / "snap")
    first = [note(i, 1, f"See [[n{i + 1}]] and it depends on [[n9]].") for i in range(40)]
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    done = snapshots.rebuild(make(first), folder, buckets=8).collect()
    assert {r["change"] for r in done} == {"new"} and len(done) == 40
    nodes, edges = state(spark, folder)
    assert len(nodes) == 40 and ("n/3.md", "n4", "depends-on") in edges
    before = files(folder)
    assert snapshots.rebuild(make(first), folder, buckets=8).collect() == [] and files(folder) == before
    second = [note(0, 2, "It was fixed in [[n5]]."), *first[2:], note(3, 1, "older words [[n7]]"), note(50, 1, None)]
    done = {r["path"]: r["change"] for r in snapshots.rebuild(make(second), folder, buckets=8).collect()}
    assert done == {"n/0.md": "changed", "n/1.md": "gone", "n/50.md": "new"}
    after = files(folder)
    kept = {k for k in before if after.get(k) == before[k]}
    assert kept and len({d for d, _ in set(before) - kept}) <= 3
    nodes, edges = state(spark, folder)
    assert "n/1.md" not in nodes and {e for e in edges if e[0] == "n/0.md"} == {("n/0.md", "n5", "fixed")} and len(nodes) == 40
    # What is gone comes back, a batch alone drops nothing, an empty corpus drops all.
    assert [tuple(r) for r in snapshots.rebuild(make([note(1, 1, "[[n2]]")]), folder, whole=False, buckets=8).collect()] == [("n/1.md", "new")]
    assert len(state(spark, folder)[0]) == 41
    assert {r["change"] for r in snapshots.rebuild(make([]), folder, buckets=8).collect()} == {"gone"} and state(spark, folder) == (set(), set())


def test_stream_of_saves(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "snap")
    saves = [[note(1, 1, "[[n2]]"), note(2, 1, "x")], [note(1, 3, "[[n3]]")], [note(1, 2, "late [[n8]]"), note(3, 1, "[[n1]]")]]
    for i, rows in enumerate(saves):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/{i}")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source + "/*")
    for checkpoint in ("a", "b"):  # the second delivers all again
        follow(stream(), folder, str(tmp_path / checkpoint), buckets=4).awaitTermination(120)
        assert state(spark, folder) == ({"n/1.md", "n/2.md", "n/3.md"}, {("n/1.md", "n3", "references"), ("n/3.md", "n1", "references")})
