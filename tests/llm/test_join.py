"""The n-gram join, its parts and the components, against brute force."""

import random
import re

import numpy as np

from quernel.llm.components import connected
from quernel.llm.ngram_join import JoinParams, components, deduplicate, least_difference, _parities, _deltas, _undeltas
from quernel.llm.prefix_tree import build, links, similar


def shingles(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near(rnd, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
    return " ".join(w)


def corpus(words, seed):
    rnd = random.Random(seed)
    texts = [None, "", " \t ", "one", "One", "one two three", "ONE two  three", "É é É é É"]
    common = words(900, 60)
    for g in range(12):
        base = words(1000 * g, rnd.choice([30, 80, 200]))
        texts += [base, base.upper(), *(near(rnd, base, rnd.randrange(1, 6)) for _ in range(rnd.randrange(8)))]
    texts += [common + " " + words(50_000 + 500 * i, 100) for i in range(60)]
    hub = words(77_000, 150)
    texts += [near(rnd, hub, rnd.randrange(4)) for _ in range(70)] + [hub] * 40
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_components_equal_brute_force(make, words):
    for seed, params in ((1, JoinParams()), (2, JoinParams(pair_list=4, block=1000, frequent=50, broadcast_ids=0, pivots=2)), (3, JoinParams(percent=60, pair_list=8, block=400, pivots=1))):
        rows = corpus(words, seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in components(make(rows), params=params).collect()}
        assert got == brute(rows, params.percent)


def test_edges_of_the_input(make, words):
    assert components(make([])).collect() == []
    rows = [(3, words(0, 20)), (3, words(0, 20)), (None, words(0, 20)), (1, words(5, 3)), (None, None)]
    got = sorted(tuple(r) for r in components(make(rows)).collect() if r.doc_id is not None)
    assert got == [(1, 1, 1), (3, 17, 3), (3, 17, 3)]
    long = words(0, 60_000)
    assert {r.component_id for r in components(make([(1, long), (2, long + " end"), (9, "x")])).collect()} == {1, 9}


def test_words_of_one_weak_hash_stay_apart(make, alike):
    got = {r.doc_id: r.component_id for r in components(make([(1, alike[0]), (2, alike[1]), (3, alike[0].upper())])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_deduplicate_keeps_one_of_each_group(make, words):
    rows = [(5, words(0, 50)), (2, words(0, 50)), (7, words(900, 50)), (7, words(900, 50)), (None, "a b c d e"), (8, None), (9, "")]
    kept = deduplicate(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 7, 8, 9]


def test_deduplicate_keeps_other_texts_of_an_id(make, words):
    a, b, c = words(0, 50), words(900, 50), words(2000, 50)
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b), (8, c), (8, c + " end"), (8, None), (8, None), (9, "")]
    kept = sorted((r.doc_id, r.text) for r in deduplicate(make(rows)).collect() if r.text)
    assert kept[:3] == [(3, a), (5, b), kept[2]] and kept[2][0] == 8 and kept[2][1] in (c, c + " end") and len(kept) == 3
    assert sorted(r.doc_id for r in deduplicate(make(rows)).collect() if not r.text) == [8, 9]


def test_prefix_tree_finds_all_similar_sets():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.choice(400, 40, replace=False)
        sets = {tuple(sorted(set(np.where(rng.random(40) < 0.1, rng.integers(0, 500, 40), base)))) for _ in range(25)}
        sets |= {tuple(sorted(rng.choice(500, rng.integers(1, 30), replace=False))) for _ in range(10)}
        sets = [np.array(s, np.uint64) for s in sorted(sets)]
        tree = build(sets)
        mark = np.zeros(tree.vocabulary, np.int8)
        for percent in (50, 85):
            for i, x in enumerate(sets):
                expected = {j for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))}
                assert set(similar(tree, i, mark, percent).tolist()) == expected
            assert not mark.any()
        assert len(links(sets, 85)) < len(sets)


def test_bounds_and_codes():
    rng = np.random.default_rng(1)
    for n, m in ((5, 6), (100, 130), (3000, 2500)):
        a, b = (np.unique(rng.integers(0, 4000, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (n, m))
        assert least_difference(_parities(a), _parities(b)) <= len(np.setxor1d(a, b))
    for values in ([], [7], [0, 1, 2**31], [5, 2**40, 2**47]):
        v = np.array(values, np.uint64)
        assert _undeltas(_deltas(v)).tolist() == values if values else True


def test_connected_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(rnd.randrange(300, 900), rnd.randrange(300, 900)) for _ in range(260)] + [(5000, 5000 + i) for i in range(1, 50)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long").repartition(7)).collect()}
    assert got == {x: root(x) for x in up if x in got} and len(got) == len({x for e in edges if e[0] != e[1] for x in e})
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
