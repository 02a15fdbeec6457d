"""SimHash components against all pairs, on texts and on planted fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from quernel.llm import golay
from quernel.llm.components import connected
from quernel.llm.simhash import SimhashParams, links, near_duplicates


def brute_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{vertex: smallest reachable}, by comparing all pairs."""
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_the_code_covers_and_pairs_share_an_anchor():
    patterns, _ = golay.errors(0)
    assert sorted(golay.syndromes(patterns)) == list(range(2048))
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 46, 3000)
    rows, homes = golay.anchors(x, 0)
    assert rows.tolist() == list(range(3000))
    y = x.copy()
    for i in range(3000):
        for bit in rng.choice(46, i % 4, replace=False):
            y[i] ^= 1 << int(bit)
    far, whole = (set(zip(*(c.tolist() for c in golay.anchors(y, reach)))) for reach in (2, 3))
    assert set(enumerate(homes.tolist())) <= whole
    rows, near = golay.anchors(x, 1)
    assert {i for i, a in zip(rows.tolist(), near.tolist()) if (i, a) in far} == set(range(3000))


@pytest.mark.parametrize("block", [2048, 3])
def test_links_of_planted_fingerprints(spark, block):
    rng = random.Random(block)
    prints = {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1}
    for p in list(prints):
        for _ in range(rng.randint(0, 8)):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << bit
            prints.add(p)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in connected(links(df, SimhashParams(block=block))).collect()}
    want = brute_components([p % 2**64 for p in signed])
    groups = lambda f: {frozenset(p for p in want if f(p) == r) for r in map(f, want)}
    back = {p % 2**64: roots.get(p, p) % 2**64 for p in signed}
    assert groups(back.get) == groups(want.get)


def test_documents_equal_brute_force(make, words, spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "One", "one two", "ONE\x0btwo", "É é", "x\x00y z w", "word " * 50_000]
    for first in range(0, 3000, 300):
        base = words(first, 250).split()
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(3, ""), (None, texts[-1])]
    got = near_duplicates(make(rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [brute_print(t) for _, t in rows]
    root = brute_components(set(prints))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = [(i, f"{p:016x}", least[root[p]]) for (i, _), p in zip(rows, prints)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert any(c != i for i, _, c in want[20:])


def test_empty_table(make):
    assert near_duplicates(make([])).collect() == []
