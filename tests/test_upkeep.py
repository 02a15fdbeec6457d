"""Upkeep on odd bodies, splits and audits."""

from pyspark.sql import functions as F

from quernel.operators import lint, recall, upkeep

FOOT = f"{upkeep.BEGIN}\n\n**Referenced by:**\n\n- [[a]]\n- [[c]]\n\n{upkeep.END}"


def test_footers_are_put_replaced_and_left(spark):
    notes = [("a", "one\n"), ("b", f"two\n\n{upkeep.BEGIN}x{upkeep.END}\nmine $1 \\d"), ("c", f"three\n\n{upkeep.BEGIN}\nold\n{upkeep.END}\n"), ("d", None), ("e", f"five\n\n{FOOT}\n"), ("f", "six")]
    edges = [("a", "b"), ("c", "b"), ("a", "b"), ("a", "d"), ("c", "d"), ("a", "a"), ("a", "e"), ("c", "e")]
    make = lambda: upkeep.backlink_footers(spark.createDataFrame(notes, "path string, body string"), spark.createDataFrame(edges, "s string, t string"))
    got = {r["path"]: r["body"] for r in make().collect()}
    assert got == {"b": f"two\n\n{FOOT}\nmine $1 \\d", "c": "three\n", "d": f"\n\n{FOOT}\n"}
    notes = [(p, got.get(p, b)) for p, b in notes]
    assert make().collect() == []


def test_requests_and_splits(spark):
    m = spark.createDataFrame([("u:1", 5, None), ("u:2", 4, None), ("u:3", 9, "f.md"), ("", 9, None), (None, 9, None)], "uri string, mentions long, file string")
    assert [tuple(r) for r in upkeep.rollup_requests(m).collect()] == [("entity-rollup", "u:1", "mentioned in 5 notes with no entity file")]
    plans = [(["a"], "no split"), ([], "no split"), (None, "no split"), (["a", "b"], None), (["a", None], "no slug at 1"), (["a", "B"], "bad slug at 1"), (["a", "b", "a", ""], "repeated slug at 2"), (list("abcdefg"), "a list")]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(plans)], "i int, p array<string>")
    assert {r["i"]: r["r"] for r in df.select("i", upkeep.split_reason(F.col("p")).alias("r")).collect()} == {i: w for i, (_, w) in enumerate(plans)}


def test_excerpts_of_short_and_long_texts(spark):
    long = "h" * 900 + "".join(f" filler{i}" for i in range(400)) + " rare rare word " + "".join(f" filler{i}" for i in range(400)) + "t" * 500
    rows = [(1, "what of rare words", long), (2, "q", "short"), (3, None, long), (4, "rare", None)]
    df = spark.createDataFrame(rows, "k int, question string, text string")
    terms, n = upkeep.document_frequencies(df, "text")
    got = {r["k"]: r["excerpt"] for r in upkeep.answer_excerpts(df, "question", "text", terms, n, "k").collect()}
    assert got[2] == "short" and got[4] is None
    head, first, second, tail = got[1].split("\n[...]\n")
    assert head == "h" * 900 and tail == "t" * 500 and "rare rare word" in first and len(first) == len(second) == 700
    assert got[3].split("\n[...]\n")[1] == long[900:1600]


def test_admissible_folders_and_filters(spark):
    paths = ["a/b.md", "_inbox/b.md", "a/_archive/b.md", "scratch/x.md", ".hidden/x.md", "a/.x/y.md", "scratch.md", "x"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = lambda **k: [r["path"] for r in df.where(recall.admissible(F.col("path"), **k)).collect()]
    assert kept() == ["a/b.md", "scratch.md", "x"] and kept(inbox=True, archive=True) == ["a/b.md", "_inbox/b.md", "a/_archive/b.md", "scratch.md", "x"]
    assert lint.parse_filter("Status='active' and tag=\"x y\"") == {"status": "active", "tag": "x y"} and lint.parse_filter(" ") == {}
