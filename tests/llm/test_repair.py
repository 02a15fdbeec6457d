"""Conversation repair against a search over all edits, SQL, and conversations that many tasks share."""

import hashlib
import heapq
import random

import duckdb
import pytest

from quernel.llm import registry
from quernel.llm.conversation_repair import damage, repair_report, repaired_turns

SPACE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, edits, lines) of rows (role, text, fault) by uniform-cost search, in which equal costs are taken in the
    order of their edits."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, j, state, lines = heapq.heappop(heap)
        if j == len(rows) and state in ("", "a"):
            return cost, edits, lines
        if (j, state) in done:
            continue
        done.add((j, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in NEXT:
                heapq.heappush(heap, (cost + 3, edits + "I", j, role[0], (*lines, f"{role}:")))
        if j == len(rows):
            continue
        role, text, fault = rows[j]
        heapq.heappush(heap, (cost + 4, edits + "D", j + 1, state, lines))
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault else 0
            if (state, role[:1]) in NEXT:
                heapq.heappush(heap, (cost + extra, edits + "K", j + 1, role[:1], (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if (state, other[0]) in NEXT:
                    heapq.heappush(heap, (cost + extra + 3, edits + "R", j + 1, other[0], (*lines, f"{other}:{text}")))


def expected(rows):
    """The report of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, found = set(), []
    for _, role, text in rows:
        inner = text.rstrip(SPACE)
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, edits, lines = cheapest(found)
    faults = [f for _, _, f in found]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, part int, seen int"


def conversation(rng, n):
    texts = ["Yes.", "no", "", " \n", "What?", "Ünd so.", "a.\t", "b!", "c", "d."]
    roles = ["user", "assistant", "system", "tool", " ", "", "agent"]
    return [(rng.choice([None, *range(9)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]


def rows_of(spark, by_conv):
    return spark.createDataFrame([(c, *r, False, 1, 2) for c, rows in by_conv.items() for r in rows], SCHEMA)


def as_dict(report):
    return {r["conv_id"]: tuple(r)[1:] for r in report.collect()}


def test_report_equals_search_over_all_edits(spark):
    rng = random.Random(5)
    by_conv = {i or None: conversation(rng, rng.randint(1, 9)) for i in range(300)}
    got = as_dict(repair_report(rows_of(spark, by_conv)))
    assert got == {c: expected(rows) for c, rows in by_conv.items()}


@pytest.mark.parametrize("seed", range(3))
def test_a_conversation_over_many_tasks(spark, seed):
    rng = random.Random(seed)
    long = [(i // 2, *r[1:]) for i, r in enumerate(conversation(rng, 60))]
    long = [(t, r, f"{x} {t}." if rng.random() < 0.7 else x) for t, r, x in long]
    by_conv = {1: conversation(rng, 4), 2: long, 3: conversation(rng, 5)}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = rows_of(spark, by_conv)
        assert as_dict(repair_report(rows)) == {c: expected(r) for c, r in by_conv.items()}
        turns = sorted(repaired_turns(rows).where("conv_id = 2").collect(), key=lambda r: r["place"])
        text = "\n".join(f"{r['role']}:{r['text']}" for r in turns)
        assert hashlib.sha256(text.encode()).hexdigest() == expected(long)[-1]
        assert "".join(r["edit"] for r in turns) == expected(long)[-2].replace("D", "")
        assert len({r["place"] >> 32 for r in turns}) > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(11)
    rows = [(c, t, r, x) for c in [None, *range(40)] for t, r, x in conversation(rng, rng.randint(1, 7))]
    rows += [(50, 3, None, None), (51, None, None, "x."), (52, 1, "user", "long. " * 20000), (53, 0, "user", "Hi."), (53, 0, "user", "Hi.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["op11_conversation_repair"])
    names = [c[0] for c in want.description]
    got = registry.op11_conversation_repair(spark, str(tmp_path)).select(names).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)


def test_empty_table_and_dropped_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_report(damage(empty)).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "x", True, 1, 1)], SCHEMA)
    assert as_dict(repair_report(rows)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
