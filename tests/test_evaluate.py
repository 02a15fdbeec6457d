"""Paired tests against plain Python."""

import math
import random
from itertools import combinations, product

from pyspark.sql import functions as F

from quernel.operators import evaluate


def test_mcnemar_of_all_small_splits(spark):
    rows = [(w, l) for w in range(9) for l in range(9)] + [(700, 900), (2000, 2000)]
    got = spark.createDataFrame(rows, "w long, l long").select("w", "l", evaluate.mcnemar_p(F.col("w"), F.col("l")).alias("p")).collect()
    for r in got:
        n = r.w + r.l
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(r.w, r.l) + 1)) / 2**n) if n else 1.0
        assert abs(r.p - want) < 1e-9 * max(1, n)


def test_permutation_and_sign_flip(spark):
    rnd = random.Random(1)
    runs = [(g, i % 2 == 0, round(rnd.gauss(g * (i % 2), 1), 3)) for g in (0, 1, 2) for i in range(9)] + [(3, True, 1.0), (4, False, None), (5, True, 1.0), *((5, False, float(i)) for i in range(25))]
    df = spark.createDataFrame(runs, "g int, arm boolean, v double")
    got = {r["g"]: r["p"] for r in evaluate.permutation_tests(df, "g", "arm", "v").collect()}
    for g in (0, 1, 2):
        a, b = ([v for k, s, v in runs if k == g and s is side] for side in (True, False))
        pool, seen = a + b, abs(sum(a) / len(a) - sum(b) / len(b))
        splits = [abs(sum(c) / len(a) - (sum(pool) - sum(c)) / len(b)) for c in combinations(pool, len(a))]
        assert abs(got[g] - sum(x >= seen - 1e-12 for x in splits) / len(splits)) < 1e-12
    assert got[3] is None and got[4] is None and got[5] is None
    flips = {r["g"]: r["p"] for r in evaluate.sign_flip_tests(df, "g", "v").collect()}
    for g in (0, 1, 2):
        d = [v for k, _, v in runs if k == g]
        sums = [abs(sum(s * x for s, x in zip(signs, d))) for signs in product((1, -1), repeat=len(d))]
        assert abs(flips[g] - sum(x >= abs(sum(d)) - 1e-12 for x in sums) / len(sums)) < 1e-12
    assert flips[3] == 1.0 and flips[4] is None and flips[5] is None
