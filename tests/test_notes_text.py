"""Chunks and aliases of notes against the rules stated plainly."""

import random
import re

import pytest

from quernel.operators import aliases, chunking


def test_windows_keep_the_budget_and_all_text():
    rnd = random.Random(4)
    pool = [*map(chr, (*range(97, 123), *range(0xE0, 0x110), *range(0x4E00, 0x4E20)))]  # each once, so places are known
    for _ in range(300):
        title = "".join(rnd.choice("aé ") for _ in range(rnd.randint(0, 8)))
        body = "".join(rnd.sample(pool, rnd.randint(0, 100)))
        budget = rnd.randint(0, 60)
        got = chunking.windows(title, body, budget)
        t, b = title.strip(), body.strip()
        whole = "\n\n".join(x for x in (t, b) if x)
        prefix = len(f"{t}\n\n".encode()) if t else 0
        if budget <= 0 or len(whole.encode()) <= budget:
            assert got == [whole]
        elif budget - prefix <= 0:
            assert len(got) == 1 and whole.startswith(got[0]) and budget - 3 < len(got[0].encode()) <= budget
        else:
            room = budget - prefix
            assert all(len(c.encode()) <= max(budget, prefix + 3) for c in got)
            pieces = [c[len(t) + 2 if t else 0 :] for c in got]
            at = 0  # each begins within the one before or right after it
            for p in pieces:
                start = b.index(p)
                assert 0 <= start <= at
                at = max(at, start + len(p))
            assert at == len(b)


def test_two_levels_number_through(spark):
    body = "intro\n# A\none\n### C\n```\n# no\n```\n~~~\n## neither\n~~~\n# \n\n## D  \n" + "x" * 50
    docs = spark.createDataFrame([(1, "T", body), (2, None, None), (3, "T", " \n"), (4, "t" * 40, "b" * 30), (5, None, "plain")], "k long, title string, body string")
    plain = [tuple(r)[1:] for r in sorted(chunking.build_chunks(docs, "title", "body", "k").where("k = 1").collect(), key=lambda r: r.chunk_idx)]
    assert plain == [
        (0, "", "intro"), (1, "A", "# A\none"), (2, "A > C", "### C\n```\n# no\n```\n~~~\n## neither\n~~~"), (3, "", "# "), (4, "D", "## D  \n" + "x" * 50),
    ]
    cut = chunking.build_chunks(docs, "title", "body", "k", 40).collect()
    assert {r.k for r in cut} == {1, 4, 5}
    ones = sorted((r.chunk_idx, r.header_path, r.content) for r in cut if r.k == 1)
    assert [i for i, _, _ in ones] == list(range(len(ones))) and all(c.startswith("T\n\n") for _, _, c in ones)
    assert [(r.chunk_idx, r.content) for r in cut if r.k == 4] == [(0, "t" * 40)]
    got = {(r.k, r.chunk_idx): r.content for r in chunking.window_chunks(docs, "title", "body", "k", 40).collect()}
    assert got[2, 0] == "" and got[5, 0] == "plain" and got[4, 0] == "t" * 40 and (4, 1) not in got


def brute_aliases(title, body):
    """By trying every run of words for every acronym."""
    text = f"{title}\n{body}"
    found = []

    def spells(phrase, acronym):
        letters = [c for c in acronym.lower() if c.isalpha()]
        for w in re.findall("[A-Za-z][A-Za-z0-9]*", phrase):
            if letters and w[0].lower() == letters[0]:
                letters.pop(0)
        return not letters

    for m in re.finditer(r"\b([A-Z][A-Z0-9]{1,7})\s*\(([^)]{2,80})\)", text, re.A):
        if spells(m[2], m[1]):
            found += [m[1], m[2].strip()]
    for m in re.finditer(r"\(([A-Z][A-Z0-9]{1,7})\)", text):
        before = text[: m.start()]
        n = sum(c.isalpha() for c in m[1])
        starts = [w.start() for w in re.finditer("[A-Za-z][A-Za-z0-9]*", before)]
        for k in range(n, 2 * n + 1):
            if k <= len(starts) and spells(before[starts[-k] :], m[1]):
                found += [m[1], before[starts[-k] :].strip()]
                break
    return found


def test_acronyms_equal_trying_all_runs():
    rnd = random.Random(9)
    words = "Open knowledge format of the best match Query x A1 lots (see below) OKF (Open Knowledge Format) (OKF) (BM25) (QA) FTS5 (full text search) é, ; `a-b` ok.".split()
    pairs = 0
    for _ in range(800):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))
        got = [a for p in aliases.acronym_pairs("t\n" + text) for a in p]
        assert got == brute_aliases("t", text)
        pairs += len(got)
    assert pairs > 40


def test_identifiers_and_the_cap(spark):
    body = "use idx_timestamp_desc and noteType, StorageRules not The; `my-kebab-name` but well-known `x y`; the_and_for a_b Go"
    many = " ".join(f"name{chr(97 + i)}_part{i:02}" for i in range(20))
    docs = spark.createDataFrame([(1, None, body), (2, None, None), (3, "T", many)], "k long, title string, body string")
    got = {r.k: r.aliases for r in aliases.derived_aliases(docs, "title", "body", "k").collect()}
    assert got[1] == ["a_b", "desc", "idx", "idx_timestamp_desc", "kebab", "my", "my-kebab-name", "name", "note", "noteType", "Rules", "Storage", "StorageRules", "the_and_for", "timestamp", "Type"]
    assert got[2] == [] and len(got[3]) == 24 and got[3] == sorted(got[3], key=str.lower)
    one = spark.createDataFrame([(1, "Open Knowledge Format (OKF)", "OKF (open kind format), OKF (nope)")], "k long, title string, body string")
    assert sorted(tuple(r)[1:] for r in aliases.acronyms(one, "title", "body", "k").collect()) == [("OKF", "Open Knowledge Format"), ("OKF", "open kind format")]


@pytest.mark.parametrize("alias,source,want", [
    ("", "x", False), (" ", "x", False), ("...", "x y", False), ("ab", "x", True), ("Format", "open format", True), ("OKF", "an (Open) Knowledge format", True), ("OKF", "open the knowledge format", False),
    ("open knowledge format", "the OKF, here", True), ("blue sky", "sky is blue", True), ("blue sky", "sky is red", False), (None, "x", False), ("abc", None, False), ("c-d", "x", True),
])
def test_derivable(spark, alias, source, want):
    df = spark.createDataFrame([(alias, source)], "a string, s string")
    assert df.select(aliases.derivable(df.a, df.s)).first()[0] is want


def test_entities_of_all_kinds(spark):
    from quernel.functions import text as X

    body = "See acme/Tool#12 (#34) #5\n#67 at https://github.com/A/b.git, github.com/x/ deadbeef1 1234567 cl/9\n```\n#99 feedbee1\n```\n[#34"
    df = spark.createDataFrame([(body,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(X.entity_uris(df.t)).collect()]
    assert got == [["cl:9", "commit:deadbeef1", "issue:#34", "issue:#67", "issue:acme/tool#12", "repo:a/b"], None, []]
