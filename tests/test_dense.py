"""Vectors of several widths, nulls and blocks against plain numpy."""

import numpy as np
import pytest

from quernel.operators import dense

ROWS = [
    (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.5]), (5, None), (6, []), (7, [1.0, None]), (8, [0.0, 0.0]), (9, [0.2, 0.9, 0.5]), (10, [5.0, 0.1]),
]
KIND = "vec_id long, embedding array<float>"


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def usable(v):
    return bool(v) and None not in v


@pytest.mark.parametrize("block", [16_384, 2])
def test_search_of_two_widths_and_nulls(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "QUERY_BLOCK", block)
    asked = [(100, None), (101, [1.0, 0.2]), (102, [0.0, 1.0, 1.0]), (103, []), (104, [1.0] * 5), (105, [0.0, 0.0])]
    vectors = spark.createDataFrame(ROWS, KIND)
    got = dense.vector_search(vectors, spark.createDataFrame(asked, "query_id long, embedding array<float>"), 2).collect()
    want = set()
    for q, v in asked:
        scores = sorted((-round(cosine(v, w), 6), i) for i, w in ROWS if usable(v) and usable(w) and len(v) == len(w))
        want |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(scores[:2])}
    assert {(r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in got} == {(q, i, round(s, 6), r) for q, i, s, r in want}
    none = spark.createDataFrame([(1, None)], "query_id long, embedding array<float>")
    assert dense.vector_search(vectors, none, 3).collect() == []
    assert dense.vector_search(vectors.limit(0), none, 3).collect() == []


@pytest.mark.parametrize("block", [4096, 2])
def test_pairs_of_two_widths_and_nulls(spark, block):
    got = dense.similar_pairs(spark.createDataFrame(ROWS, KIND), 0.6, block=block).collect()
    want = {(i, j) for i, v in ROWS for j, w in ROWS if i < j and usable(v) and usable(w) and len(v) == len(w) and cosine(v, w) >= 0.6}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_dispersion_equals_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, rng.normal(size=6).tolist()) for g in (1, 2) for i in range(9)] + [(1, 9, [0.0] * 6), (2, 9, None), (3, 0, [1.0, 2.0]), (2, 10, [1.0, 1.0]), (None, 0, [1.0]), (None, 1, [2.0])]
    got = {r["g"]: (r["n"], r["mean_similarity"]) for r in dense.dispersion(spark.createDataFrame(rows, "g int, i int, embedding array<double>"), "g").collect()}
    for g, (n, mean) in got.items():
        own = [v for k, _, v in rows if k == g]
        pairs = [cosine(a, b) if a and b and len(a) == len(b) else 0.0 for i, a in enumerate(own) for b in own[:i]]
        assert n == len(own) and abs(mean - (np.mean(pairs) if pairs else 0.0)) < 1e-9
    assert set(got) == {1, 2, 3, None}
