"""Operators against plain Python, with nulls, ties, empty tables and repeated rows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quernel.operators import aliases, dense, families, graph, integrity, lexical, lint, signals
from quernel.streaming import usage


def chunked(text, size, overlap):
    """The definition, one character count after another."""
    text = text or ""
    paragraphs = [p for p in text.split("\n\n") if p.strip()] or [text]
    raw, open_ = [], False
    for p in paragraphs:
        if len(p) > size:
            at = 0
            while at < len(p):
                raw.append(p[at : at + size])
                at += size - overlap
            open_ = False
        elif open_ and len(raw[-1]) + 2 + len(p) <= size:
            raw[-1] = raw[-1] + "\n\n" + p
        else:
            raw.append(p)
            open_ = True
    return [(raw[i - 1][-overlap:] if i else "") + c for i, c in enumerate(raw)]


def test_paragraph_chunks(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\n ", "one", "a\n\nb", "x" * 1700, "p" * 499 + "\n\n" + "q", "é" * 500, "\n\n\n\nz\n\n"]
    texts += ["\n\n".join("".join(rnd.choice("ab c") for _ in range(rnd.choice((3, 60, 240, 700)))) for _ in range(rnd.randrange(7))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, "one")]
    got = {}
    for r in families.chunks(spark.createDataFrame(rows, "k long, t string"), "t", "k").collect():
        got.setdefault(r.k, {})[r.chunk_idx] = r.content
    for k, t in enumerate(texts):
        assert [got[k][i] for i in range(len(got[k]))] == chunked(t, 500, 100)


def test_heading_chunks(spark):
    raw = "intro\n# A\none\n## B\ntwo\n```\n# no\n```\n# C\n\n## D\nthree"
    got = families.header_chunks(spark.createDataFrame([(1, raw), (2, None), (3, "")], "k long, t string"), "t", "k").collect()
    assert [(r.chunk_idx, r.header_path, r.content) for r in got] == [(0, "", "intro"), (1, "A", "one"), (2, "A > B", "two\n```\n# no\n```"), (3, "C > D", "three")]


@pytest.mark.parametrize("block", [512, 50])
def test_like_groups_compare_all(spark, block):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (20, 24, 60, 200)]
    rows = []
    for i in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = rnd.choice("xyz")
        rows.append((i, "".join(w) + "!" * rnd.randrange(3)))
    rows += [(200, None), (201, ""), (202, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    clean = {i: "\n".join(x for x in (" ".join(y.split()) for y in t.split("\n")) if x).lower() for i, t in rows if t is not None}
    alike = {(a, b) for a in clean for b in clean if a < b and SequenceMatcher(None, clean[a], clean[b], autojunk=False).ratio() >= 0.85}
    first = {c: min(i for i in clean if clean[i] == c) for c in clean.values()}
    apart = {(a, b) for a, b in alike if clean[a] != clean[b] and first[clean[a]] == a and first[clean[b]] == b}
    got = families.like_pairs(df, "t", "k", block=block).collect()
    assert {(r.a, r.b) for r in got} == apart and len(got) == len(apart)
    assert all(abs(r.ratio - SequenceMatcher(None, clean[r.a], clean[r.b], autojunk=False).ratio()) < 1e-12 for r in got)
    if block == 512:
        hubs, expected = [], {200: 200}
        for i in sorted(clean):
            expected[i] = next((h for h in hubs if (h, i) in alike), i)
            if expected[i] == i:
                hubs.append(i)
        assert {r.key: r.hub for r in families.like_groups(df, "t", "k").collect()} == expected


def test_snippets_hold_the_terms(spark):
    text = " ".join(f"w{i}" for i in range(100)) + " Hot, pot " + " ".join(f"v{i}" for i in range(100))
    rows = [(1, text, ["hot", "pot"]), (2, None, ["x"]), (3, "hot", ["hot"])]
    got = {r.k: r.snippet for r in families.snippets(spark.createDataFrame(rows, "k long, t string, q array<string>"), "t", "q").collect()}
    assert "[Hot,] [pot]" in got[1] and got[1].startswith("… ") and got[2] == "" and got[3] == "[hot]"


def test_long_chains_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(1000 + i, 1000 + (i + 1) % 70) for i in range(70)] + [(2000, 1003), (3000, 3000), (5, 6)]
    chains, cycles = graph.supersession(spark.createDataFrame(pairs, "new long, old long"))
    assert [tuple(r) for r in chains.collect()] == [(0, 100, 100)]
    assert {r.node for r in cycles.collect()} == {1000 + i for i in range(70)} | {3000}
    chains, cycles = graph.supersession(spark.createDataFrame([], "new long, old long"))
    assert chains.collect() == [] and cycles.collect() == []


def test_vector_search_in_batches(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, [rnd.random() for _ in range(4)]) for i in range(40)] + [(99, [1.0, 2.0]), (98, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = v.where("vec_id < 12").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, dense.vector_search(v, asked, 3).collect()))
    monkeypatch.setattr(dense, "BLOCK", 6)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 6)
    assert sorted(map(tuple, dense.vector_search(v, asked, 3).collect())) == whole and len(whole) == 36
    some = v.where("vec_id < 40")
    pairs = lambda n: sorted((r.a, r.b) for r in dense.similar_pairs(some, 0.9, block=n).collect())
    assert pairs(4096) == pairs(5)


def test_texts_that_hold_items(spark):
    docs = [(1, "xx the cat sat on a mat yy"), (2, "the cat sat"), (3, "athe cat sat on"), (4, None), (5, ""), (1, "xx the cat sat on a mat yy")]
    items = [(10, "the cat sat on"), (11, "cat"), (12, "he cat sa"), (13, "no such words here")]
    got = lexical.containing(spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(items, "i long, s string"), "t", "k", "s", "i")
    assert sorted(map(tuple, got.collect())) == sorted({(i, k) for k, t in docs for i, s in items if s in (t or "")})


def test_tokens_inside_words(spark):
    docs = [(1, "Concatenate the cats"), (2, "dog " * 200 + "cat"), (3, None), (4, "")]
    asked = [(7, ["cat", "cat", "dog", "the"]), (8, ["zebra"]), (9, [])]
    got = lexical.keyword_count(spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(asked, "query_id long, tokens array<string>"), F.lit("p"), "t", "k")
    assert sorted(map(tuple, got.collect())) == [(7, 1, 3), (7, 2, 1)]


def test_typed_edges(spark):
    raw = "---\nsupersedes: [[old]]\n---\n" + "y" * 200 + " It depends on [[a b|x]]. `[[code]]`\n```\n[[fence]]\n```\n" + "z" * 300 + " [[far#s]] and [[open"
    got = signals.typed_edges(spark.createDataFrame([(1, raw), (2, None), (3, "")], "k long, raw string"), "raw", "k")
    # The link of the front matter is a link of the file and a claim.
    assert sorted((r.target, r.edge_type) for r in got.collect()) == [("a b", "depends-on"), ("far", "references"), ("old", "supersedes"), ("old", "supersedes")]


def test_scalars_of_notes(spark):
    one = spark.range(1).select(
        signals.acronym(F.lit("application programming interface")).alias("a"), signals.polarity(F.lit("You must never")).alias("p"),
        signals.polarity(F.lit("you MUST")).alias("q"), signals.quoted_terms(F.lit("a-b c_d *")).alias("e"), signals.bound(F.lit("soon")).alias("b"),
        signals.merged_aliases(F.array(F.lit("Ab"), F.lit("ab")), F.array(F.lit("AB"), F.lit("c"), F.lit(" "))).alias("m"), signals.noise_token(F.lit("deadbeef1")).alias("n"),
        aliases.derivable(F.lit("API"), F.lit("application programming interface")).alias("d"), signals.dropped_tokens(F.lit("see `x_y` in 2024"), F.lit("see 2024")).alias("t"),
    ).first()
    assert tuple(one) == ("API", None, "positive", '"a" "b" "c_d"', None, ["Ab", "c"], True, True, ["x_y"])
    assert lint.parse_filter("status=active AND tag=x") == {"status": "active", "tag": "x"}


def test_merge_order_stops_at_cycles(spark):
    plans = spark.createDataFrame([(x,) for x in "abcdefa"], "plan string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "d"), ("e", "d"), ("f", "gone")], "plan string, needs string")
    order, left = integrity.merge_order(plans, needs)
    assert sorted(map(tuple, order.collect())) == [("a", 0), ("b", 1), ("c", 2), ("f", 0)] and {r.plan for r in left.collect()} == {"d", "e"}


def test_usage_stream(spark, tmp_path):
    rows = "event_id long, ts timestamp, event_type string, value double"
    batch = lambda xs: spark.createDataFrame(xs, "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    first = [(1, "2024-01-01 01:00:00", "a", 1.0), (1, "2024-01-01 01:00:00", "a", 1.0), (2, "2024-01-01 03:00:00", "a", 2.0), (3, "2024-01-01 04:00:00", "b", 5.0)]
    batch(first).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    batch([(9, "2024-01-09 00:00:00", "a", 9.0)]).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = usage.captures(spark, f"{tmp_path}/in/*", rows)
    out = usage.usage_by_window(stream).writeStream.format("memory").queryName("usage_out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = sorted((str(r.window_start), r.event_type, r.n, r.value) for r in spark.table("usage_out").collect())
    # Windows of five hours are aligned to 1970: one ends at 03:00 of this day.
    assert [g[1:] for g in got] == [("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 5.0)]
