"""Benchmark decontamination: leaks in, clean documents out."""

import random

from quernel.llm.decontaminate import Decontamination, contaminated, decontaminate


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


ITEM = "A train leaves the old station at 5 km from town and travels for 3 hours to reach the sea before Maria comes home"


def test_leaks_are_found(spark, make, words):
    b = items(spark, [ITEM, "short item here", None, "", ITEM + " again", words(0, 40)])
    again = ITEM.replace("5", "17").replace("3", "8").replace("Maria", "Peter")
    rows = [
        (1, "Before. " + ITEM + " After."), (2, "x " + ITEM.upper().replace("Maria", "MARIA")), (3, again), (4, words(7000, 80)), (5, None), (6, ""),
        (7, "a short, item here."), (8, words(0, 40)[:200]), (9, words(500, 30) + "\n" + words(0, 40) + " " + words(600, 9)), (1, "Before. " + ITEM + " After."), (10, words(0, 9)),
        (11, again.replace("8 hours", "17 hours")), (12, "long " * 50_000 + ITEM), (None, ITEM),
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in contaminated(make(rows), b).collect()}
    assert got[1, 0] == "verbatim" and got[3, 0] == "reparameterised" and got[7, 1] == "verbatim" and got[9, 5] == "verbatim" and (12, 0) in got
    # An upper-cased copy has the item's words in lower case.
    assert got[2, 0] == "verbatim"
    assert {d for d, _ in got} == {1, 2, 3, 7, 8, 9, 12, None}
    # Two different numbers of the item became one, so the slots are not consistent.
    assert (11, 0) not in got
    kept = decontaminate(make(rows), b)
    assert kept.columns == make(rows).columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 10, 11]


def test_empty_sides(spark, make):
    assert contaminated(make([]), items(spark, [ITEM])).collect() == []
    assert contaminated(make([(1, ITEM)]), items(spark, [])).collect() == []
    assert contaminated(make([(1, ITEM)]), items(spark, [None, "..."])).collect() == []
    assert [r.doc_id for r in decontaminate(make([(1, ITEM)]), items(spark, [])).collect()] == [1]


def test_shuffled_side_gives_the_same(spark, make, words):
    b = items(spark, [ITEM, words(0, 30)])
    rows = [(1, ITEM), (2, words(0, 30)), (3, words(50, 30))]
    key = lambda r: (r.doc_id, r.item_id)
    shuffled = Decontamination(broadcast_windows=0, broadcast_bytes=0)
    clashing = b.selectExpr("*", "1 as _bad", "2 as _h", "3 as doc_id")
    assert sorted(contaminated(make(rows), b).collect(), key=key) == sorted(contaminated(make(rows), clashing, rules=shuffled).collect(), key=key)


def letters(first, n):
    """Words without digits, all different."""
    return " ".join("".join(chr(97 + int(c)) for c in f"{i:05}") for i in range(first, first + n))


def test_changed_lengths_and_long_items(spark, make):
    long = letters(0, 25).split()
    sums = "the shop sold 90 boxes on the first day and then another 45 boxes when the rain had stopped over the town"
    b = items(spark, [" ".join(long), sums, letters(1000, 500)])
    rows = [
        (1, " ".join([*long[:12], "and", *long[12:]])), (2, " ".join([*long[:12], *long[13:]])), (3, sums.replace("90", "1,250").replace("45", "2.5")),
        (4, letters(9000, 30) + " " + letters(1100, 200) + " " + letters(9100, 30)), (5, " ".join(long[:12])), (6, letters(1100, 40)),
        (7, " ".join(long[:12])), (7, " ".join(long[12:])), (8, sums.replace("90", "17").replace("first day", "first fine day").replace("45", "17")),
    ]
    got = {(r.doc_id, r.item_id): (r.kind, r.n_windows) for r in contaminated(make(rows), b).collect()}
    assert got == {(1, 0): ("verbatim", 11), (2, 0): ("verbatim", 10), (3, 1): ("reparameterised", 15), (4, 2): ("verbatim", 193)}


def test_copies_in_a_row_are_apart(spark, make):
    one, two = (ITEM.replace("5", a).replace("3", b).replace("old", "very old").replace("Maria", n) for a, b, n in (("17", "8", "Peter"), ("21", "4", "Paula")))
    got = [tuple(r) for r in contaminated(make([(1, one + " " + two)]), items(spark, [ITEM])).collect()]
    assert [r[:2] + r[4:] for r in got] == [(1, 0, "reparameterised")]


def test_names_and_case(spark, make):
    talk = "Maria said that Peter and Paula would meet Anton near the big Tower before Clara and David went home with Emil to see the old film"
    start = "Maria sold 9 of the old chairs to her brother. (Peter) paid for them at once and then went home on foot"
    b = items(spark, [ITEM, talk, start])
    other = start.replace("Maria", "ANNA").replace("Peter", "Karl").replace("9", "12")
    rows = [
        (2, "x " + ITEM.upper()), (3, talk.lower()), (4, talk.upper()), (5, other), (6, other.replace("Karl", "ANNA")),
        (7, "NEW " * 60), (8, "Anna Bert Carl Dora Emma Fritz Gerd Hans Ida Jan Kai Lea " * 3),
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in contaminated(make(rows), b).collect()}
    assert got == {(2, 0): "verbatim", (3, 1): "verbatim", (4, 1): "verbatim", (5, 2): "reparameterised"}
    assert sorted(r.doc_id for r in decontaminate(make(rows), b).collect()) == [6, 7, 8]


def test_verbatim_copies_equal_brute_force(make, spark):
    """Texts without numbers, names and units: a leak is a text with half of an item's windows at one shift."""
    rnd = random.Random(11)
    bag = letters(0, 40).split()
    texts = [" ".join(rnd.choice(bag) for _ in range(rnd.choice((3, 8, 12, 30)))) for _ in range(12)]
    rows = []
    for i in range(120):
        w = [rnd.choice(bag) for _ in range(rnd.randrange(40))]
        if i % 3:
            item = rnd.choice(texts).split()
            a = rnd.randrange(len(item))
            w[5:5] = item[a // 2 : len(item) - a // 3]
        rows.append((i, " ".join(w)))
    expected = set()
    for j, t in enumerate(texts):
        item = t.split()
        k = min(8, len(item))
        for i, text in rows:
            w, hit = text.split(), {}
            for q in range(len(item) - k + 1):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == item[q : q + k]:
                        hit.setdefault(p - q, set()).add(q)
            if any(2 * len(x) >= len(item) - k + 1 for x in hit.values()):
                expected.add((i, j))
    got = {(r.doc_id, r.item_id) for r in contaminated(make(rows), items(spark, texts)).collect() if r.kind == "verbatim"}
    assert expected and got == expected


def test_title_case_and_number_words(make, spark):
    title = "The Old Farmer Sold 7 Brown Horses And Then 12 Grey Sheep At The Spring Market Near The River"
    plain = "a baker puts 3 loaves into each bag and then gives 9 of the full bags to every child of the village school"
    b = items(spark, [title, plain])
    rows = [
        (1, title.replace("7", "31").replace("12", "45")), (2, plain.replace("3", "three").replace("9", "nine")),
        (3, plain.replace("3", "Twelve").replace("9", "forty")), (4, title.lower().replace("7", "8").replace("12", "90")),
        (5, "Every Word Of This Line Has A Capital And There Are 7 Or 12 Of Them In All Or So It Seems To Me"), (6, title.replace("7", "five").replace("12", "five")),
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in contaminated(make(rows), b).collect()}
    assert got == {k: "reparameterised" for k in ((1, 0), (2, 1), (3, 1), (4, 0))}
