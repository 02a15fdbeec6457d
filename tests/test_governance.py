"""Paths and patterns against shell matching, and the breaker in a batch and on a stream."""

import fnmatch
import random

from quernel.operators import anomaly, governance
from quernel.streaming import breaker


def brute_governing(target, entries):
    t = (target or "").strip()
    areas = sorted((d, a) for d, a, _ in entries if a == t)
    if not t:
        return False, None, None, "greenfield"
    if areas:
        return True, *areas[0], "governed"
    t, found = t.replace("\\", "/").strip("/"), []
    for d, a, pattern in entries:
        p = pattern.strip().strip("/")
        base = p.rstrip("/*")
        if p and (t == p or t.startswith(p + "/")):
            found.append((len(p), d, a))
        elif p and any(c in p for c in "*?[") and (fnmatch.fnmatchcase(t, p) or fnmatch.fnmatchcase(t, base + "/*")):
            found.append((len(base), d, a))
    top = {(d, a) for n, d, a in found if n == max(f[0] for f in found)}
    if len(top) == 1:
        return True, *top.pop(), "governed"
    return False, None, None, "overlap" if top else "greenfield"


def test_governing_equals_shell_matching(spark):
    rnd = random.Random(6)
    part = lambda: rnd.choice(["a", "b", "ab", "c.d", "x+y"])
    globs = ["*", "?", "a*", "[ab]", "[!a]*", "**", "*.d"]
    entries = [(f"d{i % 17}", f"r{i % 5}" if i % 4 else None, "/".join(rnd.choice([part(), part(), rnd.choice(globs)]) for _ in range(rnd.randint(1, 3))) + rnd.choice(["", "/", "/**"])) for i in range(60)]
    targets = sorted({"/".join(part() for _ in range(rnd.randint(1, 4))) for _ in range(200)}) + ["r1", "r9", " /a/b/ ", "a\\b", "", None]
    got = governance.governing_design(spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame(entries, "design string, area string, pattern string"))
    assert {r["target"]: tuple(r)[1:] for r in got.collect()} == {t: brute_governing(t, entries) for t in targets}
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    reasons = {r["reason"] for r in got.collect()}
    assert reasons == {"governed", "overlap", "greenfield"}


def test_overlaps_equal_shell_matching(spark):
    rnd = random.Random(7)
    rows = [(f"p{i % 25}", "/".join(rnd.choice(["a", "b", "c", "*", "a?"]) for _ in range(rnd.randint(1, 3)))) for i in range(60)]
    want = {(a, b) for a, p in rows for b, r in rows if a != b and (fnmatch.fnmatchcase(p, r) or fnmatch.fnmatchcase(r, p))}
    assert {tuple(r) for r in governance.overlapping_plans(spark.createDataFrame(rows, "slug string, pattern string")).collect()} == want


def test_readiness_of_odd_plans(spark):
    rows = [("a", "queued", True, ["z"], ["x/*"]), ("b", "queued", True, [], ["x/y"]), ("c", "queued", True, ["d"], ["q"]), ("d", "done", False, [], []), ("e", "queued", True, None, None), ("f", "queued", True, ["d"], ["x/y", "n"])]
    df = spark.createDataFrame(rows, "slug string, status string, queued boolean, depends_on array<string>, touches array<string>")
    assert {r["slug"]: (r["verdict"], r["because"]) for r in governance.readiness(df).collect()} == {
        "a": ("waiting", ["z"]), "b": ("overlaps", ["f"]), "c": ("safe", []), "e": ("undeclared", []), "f": ("overlaps", ["b"]),
    }


def test_outer_roots(spark):
    rows = [("/home/v", "marker"), ("/home/v/deep", "repos"), ("/home/w", "marker"), ("/home/v/deep", "marker"), ("/home/v/deep/er", "marker")]
    got = {tuple(r) for r in governance.outer_roots(spark.createDataFrame(rows, "root string, kind string")).collect()}
    assert got == {("home/v/deep", "repos"), ("home/w", "marker"), ("home/v/deep/er", "marker")}


def test_breaker_in_batch_and_stream(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(s, c, rnd.choice([0, 1, 2, 3, 30, None])) for s in ("x", "y", None) for c in range(40)]
    want = []
    for s in ("x", "y", None):
        history = []
        for _, c, n in [r for r in rows if r[0] == s]:
            n = n or 0
            mean = sum(history) / len(history) if history else None
            tripped = n > 0 and len(history) >= 3 and n > 3 * mean
            want.append((s, c, n, mean, 3 * mean if history else None, tripped))
            if not tripped:
                history = (history + [n])[-8:]
    key = lambda r: (r[0] or "", r[1])
    df = spark.createDataFrame(rows, "stage string, cycle long, n int")
    got = anomaly.stage_anomalies(df, "stage", "cycle", "n").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(r[-1] for r in want)
    assert anomaly.stage_anomalies(df.limit(0), "stage", "cycle", "n").collect() == []
    folder = str(tmp_path / "in")
    stream = spark.readStream.schema("stage string, cycle long, n int").option("maxFilesPerTrigger", 1).parquet(folder + "/*")
    for i in range(4):
        df.where(f"cycle >= {10 * i} and cycle < {10 * i + 10}").coalesce(1).write.parquet(f"{folder}/{i}")
    query = breaker.stage_anomalies(stream, "stage", "cycle", "n").writeStream.format("memory").queryName("tripped").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("tripped").collect()), key=key) == sorted(want, key=key)
