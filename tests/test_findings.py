"""What a reviewer found on odd inputs and larger tables."""

import fnmatch
import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.functions import words as W
from quernel.operators import chunking, families, governance, lexical, likeness, recall, rules, signals


def test_word_borders_are_those_of_sql(spark):
    texts = ["Never use the ciónlla.", "You must plané ahead.", "éci is required.", "A ci is required.", "El ñmust_x.", "Ñmust do ci", "don't ship", "fixé", "éfix it", "x_fix"]
    asks, anchors = (X.ascii_borders(p) for p in (signals.ASKS, rules.ANCHORS))
    t = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", t.rlike(asks), F.regexp_extract_all(F.lower(t), F.lit(anchors), 1), signals.edge_type(t)).collect()
    con = duckdb.connect()
    for t, asked, found, edge in got:
        want = con.execute("SELECT regexp_matches(?, ?), regexp_extract_all(lower(?), ?), regexp_matches(?, ?)", [t, signals.ASKS, t, rules.ANCHORS, t, dict(signals.EDGE_CUES)["fixed"]]).fetchone()
        assert (asked, found, edge == "fixed") == want
    notes = spark.createDataFrame([(1, "Never use the ciónlla."), (2, "A ci is required.")], "k long, t string")
    assert {tuple(r) for r in rules.contradicted(notes, notes, "t", "k").collect()} == {(1, 2, 0, "A ci is required."), (2, 1, 0, "Never use the ciónlla.")}


def test_readiness_lists_overlaps_without_pairs_of_plans(spark):
    rnd = random.Random(4)
    words = ["a", "b", "*", "a?"]
    plans = [(f"p{i:03}", [rnd.choice(["x/*", "x/y", None, "/".join(rnd.choices(words, k=rnd.randint(1, 2)))]) for _ in range(rnd.choice([0, 1, 1, 2, 3]))]) for i in range(300)]
    rows = [(s, "queued", True, [], t) for s, t in plans]
    got = governance.readiness(spark.createDataFrame(rows, "slug string, status string, queued boolean, depends_on array<string>, touches array<string>")).collect()
    match = fnmatch.fnmatchcase
    want = {a: sorted({b for b, q in plans if a != b for x in p if x for y in q if y and (match(x, y) or match(y, x))}) for a, p in plans}
    assert {r["slug"]: r["because"] for r in got} == want
    assert {r["slug"]: r["verdict"] for r in got} == {a: "overlaps" if want[a] else "safe" if p else "undeclared" for a, p in plans}
    # Patterns meet once, however many plans have them.
    touches = spark.createDataFrame([(p,) for _, t in plans for p in t if p], "pattern string").distinct()
    assert governance._meeting(touches).count() <= touches.count() ** 2
    owners = touches.select(F.col("pattern").alias("other"), F.lit(1).alias("n"))
    spread = governance._beside(spark.range(1000).select("id", F.lit("x/*").alias("other")), owners, "other", "id")
    assert spread.count() == 1000 and spread.select(F.spark_partition_id()).distinct().count() > 1


def test_heading_chunks_read_small_batches(spark):
    import pyarrow as pa

    docs = spark.range(400, numPartitions=1).select("id", F.concat(F.lit("# a\nx\n```\n# no\n```\n"), F.expr("repeat('y ', 20000)"), F.lit("\n## b\n\n### c\nz")).alias("raw"))
    got = families.header_chunks(docs, "raw", "id")
    assert got.columns == ["id", "chunk_idx", "header_path", "content"] and got.count() == 800
    assert {(r[1], r[2]) for r in got.collect()} == {(0, "a"), (1, "a > b > c")}
    size = docs.mapInArrow(lambda bs: (pa.record_batch({"n": [b.nbytes]}) for b in bs), "n long").agg(F.max("n")).first()[0]
    assert size < 2 * chunking.BATCH_BYTES


def test_first_parts_rule_out_unlike_texts_and_no_others():
    rnd = random.Random(9)

    def changed(t):
        t = list(t)
        for _ in range(rnd.randint(0, len(t) // 4 + 1)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "é", "  "])
        return "".join(t)

    seeds = ["".join(rnd.choices("abcdefgh é", k=rnd.randint(1, 300))) for _ in range(12)]
    docs = sorted({changed(rnd.choice(seeds)) for _ in range(120)} | {"", "a"})
    ratio = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    frame = pd.DataFrame({"key": range(len(docs)), "body": docs})
    want = {(a, b, r) for b, y in enumerate(docs) for a, x in enumerate(docs[:b]) if (r := ratio(x, y)) >= 0.85}
    assert set(families._alike(frame, frame, True, 0.85)) == want and len(want) > 50
    codes = [np.frombuffer("".join(rnd.choices("abcdefghijkl", k=400)).encode(), np.uint8) % 64 for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    assert not families._possible(codes, codes, i, j, 0.85).any()


def test_first_steps_rule_out_unlike_texts_and_no_others(monkeypatch):
    rnd = random.Random(11)
    syllables = "the an er ing ou th tion st in re on ed ble ly ha ea es wh nd or ti sh nt at".split()
    prose = lambda n: " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n))
    some = [prose(160) for _ in range(60)]
    frame = pd.DataFrame({"key": range(60), "body": some})
    met = []
    monkeypatch.setattr(families, "_possible", lambda left, right, i, j, least: met.extend(i) or np.zeros(len(i), bool))
    monkeypatch.setattr(families, "_common", lambda masks, n, other: met.append(0) or 0)
    # Of 1770 pairs with the same characters few get as far as the longest common subsequence.
    assert not list(families._alike(frame, frame, True, 0.85)) and len(met) < 250
    monkeypatch.undo()

    def changed(t, alphabet):
        t = list(t)
        for _ in range(rnd.randint(0, len(t) // 5 + 1)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randint(0, 1)] = rnd.choice(["", *alphabet[:20]])
        if len(t) > 20 and rnd.random() < 0.3:
            at = rnd.randrange(len(t) - 10)
            t[at : at + 10], t[:0] = [], t[at : at + rnd.choice([5, 10])]
        return "".join(t)

    alike = 0
    monkeypatch.setattr(likeness, "_SHORT", 0)
    for alphabet in ("a", "ab", "abcdefgh ", "ab\0é😀\n", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))):
        for runs, held, columns in ((60, 1, 64), (4, 50, 1024), (0.1, 1 << 17, 100)):
            for name, value in (("_RUNS", runs), ("_TOGETHER", held), ("_COLUMNS", columns), ("_CHARACTERS", columns * 10)):
                monkeypatch.setattr(likeness, name, value)
            seeds = ["".join(rnd.choices(alphabet, k=rnd.randint(1, 90))) for _ in range(5)]
            docs = sorted({changed(rnd.choice(seeds), alphabet) for _ in range(24)} | {""})
            keys = rnd.sample(range(99), len(docs))
            both, half = pd.DataFrame({"key": keys, "body": docs}), rnd.randrange(1, len(docs))
            rows = sorted(zip(keys, docs))
            want = {(a, b, r) for n, (b, y) in enumerate(rows) for a, x in rows[:n] if (r := SequenceMatcher(None, x, y, autojunk=False).ratio()) >= 0.85}
            assert set(families._alike(both, both, True, 0.85)) == want
            first = set(keys[:half])
            assert set(families._alike(both[:half], both[half:], False, 0.85)) == {w for w in want if (w[0] in first) != (w[1] in first)}
            alike += len(want)
    assert alike > 200


def test_duplicates_are_of_one_conversation_whatever_its_id(spark):
    import hashlib

    from quernel.llm.conversation_repair import repair_report

    rows = [(" ", 0, "user", "a."), (None, 1, "user", "a."), ("x", 0, "1", ":b."), ("x:1", 5, "", "b."), ("x:1", 2**63 - 1, "user", "c."), ("x:1", 0, "user", "d.")]
    got = repair_report(spark.createDataFrame([(*r, False) for r in rows], "conv_id string, turn long, role string, text string, gone boolean")).collect()
    assert {r["conv_id"]: (r["gaps"], r["duplicate"]) for r in got} == {" ": (0, 0), None: (0, 0), "x": (0, 0), "x:1": (2**63 - 3, 0)}
    assert {r["repaired_sha256"] for r in got if r["conv_id"] is None} == {hashlib.sha256(b"user:a.\nassistant:").hexdigest()}


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


_HEADS = [(1, "Concatenate THE cats"), (2, "dog " * 200 + "cat"), (3, None), (4, ""), (5, "ñcatñ ca tKat kat"), (6, "x" * 300 + "the9cat"), (7, "cat dog"), (8, "cat dog"), (9, "ab é")]
_QUESTIONS = [(7, ["cat", "cat", "dog", "the"]), (8, ["zebra"]), (9, []), (None, ["kat", "at", "the9c", "x" * 200]), (3, None), (2, ["dog", None, "ca t"])]


@pytest.mark.parametrize("held, hits", [(100_000, 1 << 20), (100_000, 1), (0, 1 << 20)])
def test_keyword_count_takes_no_row_of_a_word_through_a_shuffle(spark, monkeypatch, held, hits):
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "_HITS", hits)
    docs, asked = spark.createDataFrame(_HEADS, "k long, t string"), spark.createDataFrame(_QUESTIONS, "query_id long, tokens array<string>")
    got = lexical.keyword_count(docs, asked, F.lit("p"), "t", "k")
    head = {k: ("p " + t[:500]).lower() for k, t in _HEADS if t is not None}
    runs = {k: re.findall("[a-z0-9]{3,}", h) for k, h in head.items()}
    want = {(q, k): n for q, ts in _QUESTIONS for k in head if (n := sum(any(t in r for r in runs[k]) for t in ts or [] if t and len(t) >= 3))}
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want and len(want) > 10
    for best in (1, 2):
        few = lexical.keyword_count(docs, asked, F.lit("p"), "t", "k", best=best)
        assert sorted(map(str, lexical.top(few, best, "k").collect())) == sorted(map(str, lexical.top(got, best, "k").collect()))
    assert not held or _shuffles(got) == 0
    assert lexical.keyword_count(docs.limit(0), asked, F.lit("p"), "t", "k").count() == 0


def _stem(t):
    for s in X.STEM_SUFFIXES:
        if t.endswith(s) and len(t) >= len(s) + X.STEM_LEFT:
            return t[: -len(s)]
    return t


@pytest.mark.parametrize("held, hits", [(100_000, 1 << 20), (100_000, 1), (0, 1 << 20)])
def test_matched_idf_takes_no_match_through_a_shuffle(spark, monkeypatch, held, hits):
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "_HITS", hits)
    rnd = random.Random(5)
    seeds = ["cat", "walk", "hop", "bus", "ies", "sing", "fly", "ñu", "ab", "x9"]
    texts = [(i, " ".join(rnd.choice(seeds) + rnd.choice(["", "", *X.STEM_SUFFIXES, "edlys", "K"]) for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "WALKING, buses\ncats\n"), (203, "walking_walks-catés")]
    asked = [(1, "walking"), (1, "walks"), (1, "cat"), (2, "cats"), (2, "busing"), (3, "singly"), (3, "sing"), (4, "nothing"), (5, "ab"), (6, None), (None, "cat"), (7, "iess")]
    got = lexical.matched_idf(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, term string"))
    stems = {k: [_stem(t) for t in re.findall("[a-z0-9]{3,}", (t or "").lower())] for k, t in texts}
    want = {}
    for q in {q for q, t in asked if q is not None and t}:
        terms = Counter(_stem(t) for i, t in asked if i == q)
        hit = [k for k, ts in stems.items() if any(t in terms for t in ts)]
        mean = sum(len(stems[k]) for k in hit) / max(len(hit), 1)
        for k in hit:
            found = [(n, stems[k].count(t), sum(t in s for s in stems.values())) for t, n in terms.items() if t in stems[k]]
            want[q, k] = sum(math.log((len(hit) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(stems[k]) / mean)) * n for n, tf, df in found)
    rows = {(r[0], r[1]): r[2] for r in got.collect()}
    assert rows == pytest.approx(want, abs=1e-9) and {q for q, _ in want} == {1, 2, 3, 7}
    few = lexical.matched_idf(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, term string"), best=3)
    assert lexical.top(few, 3, "doc_id").collect() == lexical.top(got, 3, "doc_id").collect()
    assert not held or _shuffles(got) == 0


def test_words_of_a_batch_are_those_of_each_text(monkeypatch):
    rnd = random.Random(6)
    texts = [None if rnd.random() < 0.1 else "".join(rnd.choices("abc1 \nñé_", k=rnd.randint(0, 60))) for _ in range(200)]
    for kind, some in ((pa.string(), slice(0, 200)), (pa.large_string(), slice(7, 150)), (pa.string(), slice(3, 3))):
        found, row = W.cut(pa.array(texts, kind)[some], 2)
        assert [(r, w.decode()) for r, w in zip(row.tolist(), found.to_pylist())] == [(i, w) for i, t in enumerate(texts[some]) for w in re.findall("[a-c1]{2,}", t or "")]
    known = sorted({"".join(rnd.choices("abc1", k=rnd.randint(1, 5))) for _ in range(60)} | {"ñé", "zz"})
    distinct = W.cut(pa.array(texts), 2)[0].dictionary_encode().dictionary
    want = {(i, j) for i, w in enumerate(distinct.to_pylist()) for j, k in enumerate(known) if len(k) > 1 and k.encode() in w}
    cells = np.array([rnd.randrange(50) for _ in range(400)])
    sums = [v.tolist() for v in W.sums(cells // 10, cells % 10, cells + 0.5, 5, 10)]
    for size, most in ((W._BYTES, W._CELLS), (7, 0)):
        monkeypatch.setattr(W, "_BYTES", size)
        monkeypatch.setattr(W, "_CELLS", most)
        word, place = W.inside(distinct, known, 2)
        assert set(zip(word.tolist(), place.tolist())) == want and len(want) > 100 and (np.diff(word) >= 0).all()
        assert [v.tolist() for v in W.sums(cells // 10, cells % 10, cells + 0.5, 5, 10)] == sums
    assert W.slices(np.array([5, 0, 1, 9, 0]), 3) == [(0, 2), (2, 3), (3, 5)]
    assert W.leading(np.array([3, 3, 3, 1]), np.array([1.0, 2, 2, 0]), 1, 1e-9).tolist() == [1, 2, 3]


def test_recall_shuffles_a_match_by_its_query_and_its_note_only(spark):
    rows = [(f"a/n{i}.md", f"n{i}", "active", "walking cats " * (i % 5) + f"w{i} " * (i % 3)) for i in range(40)]
    notes = spark.createDataFrame(rows, "path string, stem string, status string, body string")
    asked = spark.createDataFrame([(1, "walks"), (1, "w7"), (2, "cat"), (3, "zzz")], "query_id long, term string")
    got = recall.recall(notes, asked, 3)
    # By query for the places, by note for its weight, by query for the best.
    assert _shuffles(got) <= 3
    con = duckdb.connect()
    scores = lexical.matched_idf(notes, asked, "body", "path").toPandas()
    con.register("s", scores)
    want = con.execute("SELECT query_id, path, round(score, 9), round(1 / (60 + place), 12), place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS place FROM s) WHERE place <= 3 ORDER BY 1, 5").fetchall()
    assert [(r.query_id, r.path, r.keyword, r.score, r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == want and len(want) == 6


@pytest.mark.parametrize("cells", [1 << 22, 0])
def test_recall_ranks_the_first_places_only_and_more_where_these_settle_nothing(spark, monkeypatch, cells):
    monkeypatch.setattr(recall, "REACH", 4)
    monkeypatch.setattr(recall, "STEP", 2)
    monkeypatch.setattr(recall, "LAST", 16)
    monkeypatch.setattr(W, "_CELLS", cells)
    ranked, asked_for, scores = [], [], lexical.matched_scores

    def watched(*args, **kwargs):
        ask = scores(*args, **kwargs)

        def asked(best=None, near=0.0, only=None):
            ranked.append(ask(best, near, only))
            asked_for.append((best, None if only is None else sorted(r[0] for r in only.collect())))
            return ranked[-1]

        return asked

    monkeypatch.setattr(lexical, "matched_scores", watched)
    rnd = random.Random(8)
    words = ["cat", "dog", "bird", "oak"]
    # The old and the loaded come first for 2 and 3; all notes of 4 are loaded; 5 has few; 6 is of ties.
    rows = [(f"a/{'_index' if i == 150 else f'n{i:03}'}.md", "active", " ".join(rnd.choices(words, k=9)) + " fox" * (20 - i // 10) * (i < 60) + " elk" * (20 - i // 10) * (i < 40) + " emu" * (i < 20) + " yak" * (i in (3, 50)) + " owl" * (i % 2), 1e-3 if i in range(20, 58) else None if i == 199 else 1.0) for i in range(200)]
    notes = spark.createDataFrame(rows, "path string, status string, body string, decay double").repartition(3)
    asked = spark.createDataFrame([(1, "cat"), (1, "dog"), (2, "fox"), (3, "elk"), (4, "emu"), (5, "yak"), (6, "owl"), (7, "zzz")], "query_id long, term string")
    loaded = spark.createDataFrame([(r[0],) for r in rows[:20]], "path string")
    got = recall.recall(notes, asked, 3, {"status": "active"}, {"status": "status"}, loaded, F.col("decay"))
    con = duckdb.connect()
    con.register("s", scores(notes, asked, "body", "path")().toPandas())
    con.register("w", pd.DataFrame([(r[0], r[3], 1e-6 if "_index" in r[0] else 0.0, i < 20) for i, r in enumerate(rows)], columns=["path", "decay", "lift", "gone"]))
    want = con.execute("""WITH r AS (SELECT query_id, path, score, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path)) AS fused FROM s UNION ALL SELECT q, path, 0, 0 FROM w, (VALUES (7)) AS t(q)),
     c AS (SELECT query_id, path, round(score, 9) AS keyword, round((fused + lift) * decay, 12) AS score FROM r JOIN w USING (path) WHERE NOT gone)
     SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, path) AS rank FROM c) WHERE rank <= 3 ORDER BY query_id, rank""").fetchall()
    assert [(r.query_id, r.path, r.keyword, r.score, r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == [(q, p, pytest.approx(a, abs=2e-9), pytest.approx(b, abs=2e-12), n) for q, p, a, b, n in want]
    assert {r[0] for r in want} == {1, 2, 3, 5, 6, 7}
    # The first look takes a few rows of a task, and only what it leaves open is asked for again.
    assert asked_for[0] == (4, None) and asked_for[-1][0] is None and 2 in asked_for[1][1] and not {5, 6} & set(asked_for[1][1])
    if cells:
        assert ranked[0].groupBy(F.spark_partition_id(), "query_id").count().where("query_id = 1").agg(F.max("count")).first()[0] <= 4
