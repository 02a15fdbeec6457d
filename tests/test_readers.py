"""Transcripts and feeds: readers and mining, beside what the queries' SQL covers."""

import json
import re

from quernel.operators import mining
from quernel.sources import feeds, transcripts


def test_messages_of_odd_lines(spark):
    lines = [
        json.dumps({"type": "user", "message": {"content": "plain"}}), "{broken", "", "  \t", "[1]", "5", "null",
        json.dumps({"type": "summary", "message": {"content": "x"}}), json.dumps({"type": "user"}),
        json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, 7, "s", {"type": "thinking", "thinking": "t"}, {"type": "tool_use"}, {"type": "text"}]}}),
        json.dumps({"type": "user", "message": {"content": [{"type": "tool_use", "name": "Bash"}]}}),
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(99, None)], "i int, line string")
    got = {r["i"]: (r["kind"], r["text"], r["tools"], r["corrupt"]) for r in transcripts.messages(df, "i").collect()}
    assert got == {
        0: ("user", "plain", [], None), 1: (None, None, None, "{broken"), 8: ("user", "", [], None),
        9: ("assistant", "a [tool_use: ?] ", ["?"], None), 10: ("user", "[tool_use: Bash]", [], None),
    }


EXAMPLES = {
    "preference": ["NEVER touch it", "I prefer tabs", "use spaces not tabs", "dont add that"],
    "correction": ["Wait, it is broken", "you should not have done", "I told you to stop"],
    "idea": ["we could later add", "in future, it might work", "a followup", "could be its own", "as a follow up", "Ideas: more tests"],
    "fix": ["fixed by a patch", "Resolved By them", "a workaround", "the bug was in fact due to rain"],
}


def test_stems_stand_wherever_a_pattern_matches():
    for family, _, _, patterns in mining.FAMILIES:
        assert len(patterns) == len(mining._STEMS[family]) == len(EXAMPLES[family])
        for (pattern, _), stems, example in zip(patterns, mining._STEMS[family], EXAMPLES[family]):
            assert re.search(pattern, example, re.IGNORECASE) and any(s in example.casefold() for s in stems)


def test_candidates_count_and_fall(spark):
    said = [(1, i, "user", "Always run the tests.", []) for i in range(3)] + [(1, 3, "assistant", "Always run. Fixed by rain", ["B"] * 3), (2, 0, "user", "ALWAYS run the tests!", []),
            (2, 1, "user", "élan: never été là, I want tea", []), (3, 0, "user", "", []), (3, 1, "user", None, []), (4, 0, "assistant", "", ["T"] * 5)]
    df = spark.createDataFrame(said, "s int, i int, kind string, text string, tools array<string>")
    got = {(r["s"], r["category"], r["slug"]): (r["confidence"], r["occurrences"], r["title"]) for r in mining.candidates(df, "s", "i").collect()}
    assert got == {
        (1, "preferences", "always-run-the-tests"): ("MEDIUM", 3, "Always run the tests"), (1, "fix", "always-run-fixed-by-rain"): ("LOW", 1, "Fix: Always run. Fixed by rain"),
        (1, "workflow", "workflow-b"): ("MEDIUM", 3, "Workflow: B used 3x"), (2, "preferences", "always-run-the-tests"): ("LOW", 1, "ALWAYS run the tests"),
        (2, "preferences", "never-t-l"): ("LOW", 1, "never été là"), (2, "preferences", "i-want-tea"): ("HIGH", 1, "I want tea"),
    }
    state = spark.createDataFrame([(1, "done"), (2, "error")], "s int, status string")
    assert {r["s"] for r in mining.unmined(df, state, "s").collect()} == {2, 3, 4}


def test_feed_items_of_both_kinds(spark):
    rss = """<?xml version="1.0"?><rss xmlns:content="urn:c"><channel><item><title> A &amp; B </title><link>http://x/1</link><category> AI </category><content:encoded>&lt;p&gt;long&lt;/p&gt; x</content:encoded></item>
      <item><link>http://x/2</link></item><item><title>no tag</title></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T</title><link rel="self" href="http://x/3"/><category term="ai"/><summary>s</summary></entry></feed>"""
    many = "<rss><channel>" + "".join(f"<item><title>t{i}</title><category>{'ai' if i % 2 else 'b'}</category></item>" for i in range(60)) + "</channel></rss>"
    rows = [(1, rss), (2, atom), (3, rss[:-6]), (4, "no xml"), (5, None), (6, ""), (7, many)]
    df = spark.createDataFrame(rows, "id int, body string").selectExpr("*", "concat('u', id) AS url")
    every = feeds.feed_items(df, "body", "id", "url")
    assert sorted((r["id"], r["place"], r["title"], r["body"], r["url"]) for r in every.where("id < 7").collect()) == [
        (1, 0, "A & B", "long x", "http://x/1"), (1, 1, "no tag", "", "u1"), (2, 0, "T", "s", "http://x/3"),
    ]
    tagged = feeds.feed_items(df, "body", "id", "url", wanted=("Ai",)).collect()
    assert [r["title"] for r in sorted(tagged, key=lambda r: (r["id"], r["place"]))] == ["A & B", "T", *(f"t{i}" for i in range(1, 41, 2))]
    seen = spark.createDataFrame([(1, "http://x/1")], "id int, identity string")
    new = {(r["id"], r["identity"]) for r in feeds.unseen(every.where("id < 7"), seen, "id").collect()}
    assert new == {(1, "content:e3b0c44298fc1c14"), (2, "http://x/3")}
    assert [r[0] for r in df.select(feeds.looks_like_feed(df["body"])).collect()] == [True, True, True, False, None, False, True]
