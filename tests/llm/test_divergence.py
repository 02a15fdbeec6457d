"""The divergence audit against SQL on odd texts, and its tokenizer against the pattern."""

import re

import duckdb
import numpy as np
import pytest

from quernel.llm import divergence, registry

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def test_tokenizer_equals_the_pattern():
    texts = ["", "a", "aB-c", "É été", "12", "x", "", "y_z[q]", "日本語 text", "\x7fdel\x80"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    starts, ends, rows = divergence.terms(data, offsets)
    got = [(int(r), data[s:e].tobytes().decode()) for s, e, r in zip(starts, ends, rows)]
    assert got == [(i, m) for i, t in enumerate(texts) for m in TERM.findall(t)]


def test_slices_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence, "xxh64_intdigest", lambda b: len(b) % 2)
    data = np.frombuffer(b"aabbaaccabcabc", np.uint8)
    starts, ends = np.array([0, 2, 4, 6, 8, 11]), np.array([2, 4, 6, 8, 11, 14])
    pieces, group = divergence.grouped(data, starts, ends)
    assert [pieces[g] for g in group] == [b"aa", b"bb", b"aa", b"cc", b"abc", b"abc"]
    assert len(set(pieces)) == len(pieces)


@pytest.mark.parametrize("block", [200_000, 3])
def test_audit_equals_sql_on_odd_texts(spark, tmp_path, block):
    texts = [None, "", "12 34", "the cat", "The CAT sat", "the dog. the dog", "É é ÉÉ", "日本語 the", "a-b-a_b", "x" * 300 + " the", "the " * 20000]
    rows = [(i, t, g, s, 1, 2) for i, (t, g, s) in enumerate(
        [(t, g, s) for t in texts for g in ("en", "de", None) for s in ("a", "b", None)] + [("only here", "fr", "a"), ("", "fr", "b"), (None, "xx", "a")] + [("the cat", "en", "hot")] * 40)]
    schema = "doc_id long, text string, lang string, source string, n int, term int"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["op13_source_divergence"])
    names = [c[0] for c in want.description]
    got = divergence.audit(docs, divergence.DivergenceParams(block=block)).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert {r["lang"] for r in got} == {"", "de", "en", "fr"}


def test_empty_table(make):
    assert divergence.audit(make([])).collect() == []
