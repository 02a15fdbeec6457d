"""Benchmark decontamination by template canonicalisation [native: DataFrame functions only].

Both sides are brought to templates: numbers, names and units become typed placeholders, all else
lower-case words. Any capitalised word is a name, at whatever place, so a template's window needs some words
of its own to count. Windows of the templates, of templates in which names stay words, and of the lower-case
words themselves are hash-joined, so a text in other case and an item in title case are found too. Each window
of an item has an anchor, a rare word of its own; a text's windows are hashed only where a word stands that
shares a bit with an anchor in a filter of fixed size. For each document and item, windows on
one diagonal (place in the document less place in the item) are one alignment, and so are all those on
neighbouring diagonals, as words put in or left out move what follows. An alignment that covers enough of
the item, or has a long run of its words, is then checked: it is verbatim if enough of its windows or such
a run have the item's own words, and else the values that the document puts into the placeholders of its
windows must be a function of the item's values, and differ where those differ. That catches a question
with other numbers, and leaves alone a text that only has the same frame.

Defined cases: a null or empty text has no windows and is never contaminated; an item shorter than a
window is compared as a whole, as a window of its own length; an item without words matches nothing;
equal items are reported each; repeated documents give one row per id and item; empty tables give no
rows; other columns are ignored by ``contaminated`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.durable import broadcast_if_small, cut, fresh

#: Units of measure and money, as they follow a number. Fixed values.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes hour hours day days week "
    "weeks month months year years dollar dollars euro euros cent cents percent degree degrees mph kmh watt watts volt volts"
).split()
#: Marks of the placeholders. A mark is a word of its own after canonicalisation.
NUM, NAME, UNIT = "\x01", "\x02", "\x03"
#: Stands for a point, comma or hard space between two digits, which is part of the number.
INSIDE = "\x04"
NUMBER = rf"[0-9]+(?:{INSIDE}[0-9]+)*"
#: Words that are numbers. Fixed values.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
WORDS = r"[^\p{L}\p{N}\x01-\x04]+"


@dataclass(frozen=True)
class Decontamination:
    #: Words of a window.
    window: int = 8
    #: An alignment counts from this share of the item's windows, in percent.
    min_percent: int = 50
    #: Words of its own, neither names nor numbers nor units, that a template's window of 8 words needs; in
    #: proportion for shorter ones.
    own_words: int = 3
    #: So many words of an item in a row count whatever its length.
    run_words: int = 50
    #: Item windows that are broadcast at most (some 60 bytes each); more are joined by a shuffle.
    broadcast_windows: int = 1_000_000
    #: Alignments or items that are broadcast at most, and their bytes; more are joined by a shuffle.
    broadcast_alignments: int = 100_000
    broadcast_bytes: int = 64 << 20


def _spaced(text: Column) -> Column:
    """The text without marks of its own, and with whole numbers."""
    bare = F.translate(F.coalesce(text, F.lit("")), NUM + NAME + UNIT + INSIDE, "    ")
    return F.regexp_replace(bare, r"([0-9])[.,\u00a0\u202f](?=[0-9])", f"$1{INSIDE}")


def raw_words(spaced: Column) -> Column:
    """The words of a text of ``_spaced`` as they stand; a number is a word of its own."""
    return F.array_remove(F.split(F.regexp_replace(spaced, NUMBER, " $0 "), WORDS), "")


def lower_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.lower(w))


def template_words(words: Column) -> Column:
    """The template of ``raw_words``, word for word: a number, in digits or in words, is NUM, a capitalised word is NAME,
    and a unit after a number in digits is UNIT."""
    digits = lambda w: (w >= "0") & (w < ":")

    def kind(w: Column, before: Column) -> Column:
        low, first = F.lower(w), F.substring(w, 1, 1)
        plain = F.when(digits(before) & low.isin(*UNITS), UNIT).otherwise(low)
        return F.when(digits(w) | low.isin(*NUMBER_WORDS), NUM).when(first != F.lower(first), NAME).otherwise(plain)

    # Beside each word the one before it; the last of these has no word beside it.
    return F.slice(F.zip_with(words, F.concat(F.array(F.lit("")), words), kind), F.lit(1), F.size(words))


def _with_names(template: Column, raw: Column) -> Column:
    """The template with its names as words."""
    return F.zip_with(template, raw, lambda c, w: F.when(c == NAME, w).otherwise(c))


def _own(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(NUM, NAME, UNIT))


def _item_windows(items: DataFrame, rules: Decontamination) -> DataFrame:
    """(item_id, _k, _total, _n, _q, _h, _anchor) of the item's words, of its template, and of its template with names
    as words. ``_anchor`` is a word of the window's own that a text with the window has at the same place: the one
    that the benchmark has least often, of these the longest."""
    k, n = F.col("_k"), F.size("_iw")
    places = items.select("item_id", "_k", n.alias("_n"), (n - k + 1).alias("_total"), "_ir", "_iw", F.explode(F.sequence(F.lit(0), n - k)).alias("_q"))
    raw, template = (F.slice(c, F.col("_q") + 1, k) for c in ("_ir", "_iw"))
    named = _with_names(template, raw)
    # A window with few words of its own is no frame.
    framed = lambda t: F.size(_own(t)) * rules.window >= k * rules.own_words
    kinds = F.array(
        F.struct(F.xxhash64(raw).alias("_h"), raw.alias("_a")),
        F.when(framed(template), F.struct(F.xxhash64(template).alias("_h"), _own(template).alias("_a"))),
        F.when(framed(named), F.struct(F.xxhash64(named).alias("_h"), _own(named).alias("_a"))),
    )
    windows = places.select("item_id", "_k", "_total", "_n", "_q", F.inline(F.array_compact(kinds))).distinct()
    often = items.select(F.explode("_ir").alias("_word")).groupBy("_word").agg(F.count("*").alias("_often"))
    words = windows.withColumn("_word", F.explode("_a")).join(often, "_word")
    first = F.min_by("_word", F.struct("_often", -F.length("_word"), "_word"))
    return words.groupBy("item_id", "_k", "_total", "_n", "_q", "_h").agg(first.alias("_anchor"))


#: Bits of the filter that finds anchors.
FILTER_BITS = 1 << 18


def _anchor_filter(item_windows: DataFrame) -> Column:
    """An array of longs with a bit for each anchor, by hash: 32 KiB whatever the benchmark."""
    at = F.pmod(F.xxhash64("_anchor"), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(_anchor), {FILTER_BITS}) % 64 AS INT))")
    rows = item_windows.groupBy(F.floor(at / 64).cast("int").alias("i")).agg(F.bit_or(bit).alias("bits")).collect()
    bits = dict.fromkeys(range(FILTER_BITS // 64), 0) | {r["i"]: r["bits"] for r in rows}
    # One literal, which the optimizer takes apart once.
    return F.split(F.lit(",".join(map(str, bits.values()))), ",").cast("array<bigint>")


def _anchored_places(words: str, bits: Column, k: int) -> Column:
    """Places of windows of ``k`` words that hold an anchor (or a word that shares its bit)."""
    n = F.size(words)

    def marked(w: Column) -> Column:
        at = F.pmod(F.xxhash64(w), F.lit(FILTER_BITS))
        return F.bit_get(F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1

    marks = F.filter(F.transform(words, lambda w, i: F.when(marked(w), i)), lambda i: i.isNotNull())
    starts = F.transform(marks, lambda m: F.sequence(F.greatest(m - k + 1, F.lit(0)), F.least(m, n - k)))
    return F.when(n >= k, F.array_distinct(F.flatten(starts))).otherwise(F.array().cast("array<int>"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    rules: Decontamination = Decontamination(),
) -> DataFrame:
    """One row per document and item of which it holds a part: windows hit, kind, slots."""
    texts = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_it"))
    items = cut(
        texts.withColumn("_r", raw_words(_spaced(F.col("_it"))))
        .select("item_id", "_it", lower_words(F.col("_r")).alias("_ir"), template_words(F.col("_r")).alias("_iw"))
        .withColumn("_k", F.least(F.size("_iw"), F.lit(rules.window)))
        .where("_k > 0")
    )
    item_windows = cut(_item_windows(items, rules))
    few = item_windows.count() <= rules.broadcast_windows
    sizes = sorted(r[0] for r in item_windows.select("_k").distinct().collect())  # 1 to `window`
    # Rows of the same id may hold other texts.
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("_t"), F.xxhash64(text).alias("_x"))
    split = rows.select("doc_id", "_x", raw_words(_spaced(F.col("_t"))).alias("_r"))
    worded = split.select("doc_id", "_x", lower_words(F.col("_r")).alias("_w"), template_words(F.col("_r")).alias("_c"))
    if not sizes:
        return rows.select("doc_id").join(items.select("item_id"), F.lit(False)).select(
            "doc_id", "item_id", F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("item_windows"),
            F.lit("").alias("kind"),
        )

    # Windows are hashed only where an anchor stands, as all others meet no item's.
    bits = _anchor_filter(item_windows)
    marked = worded.select("*", *(_anchored_places("_w", bits, k).alias(f"_at{k}") for k in sizes))

    def window(k: int):
        def at(p: Column) -> Column:
            raw, template = F.slice("_w", p + 1, k), F.slice("_c", p + 1, k)
            hashes = F.array(F.xxhash64(raw), F.xxhash64(template), F.xxhash64(_with_names(template, raw)))
            return F.struct(F.lit(k).alias("_k"), p.alias("_p"), F.array_distinct(hashes).alias("_hs"))

        return at

    every = F.concat(*(F.transform(f"_at{k}", window(k)) for k in sizes))
    found = marked.select("doc_id", "_x", F.inline(every)).select("doc_id", "_x", "_k", "_p", F.explode("_hs").alias("_h"))
    item_windows = item_windows.drop("_anchor")
    hits = found.join(F.broadcast(item_windows) if few else item_windows, ["_h", "_k"]).drop("_k")
    return _checked(cut(_aligned(hits, rules)), rows, items, rules)


def _has_run(places: Column, rules: Decontamination) -> Column:
    """Whether ascending places of windows hold a run of ``run_words`` words."""
    m = max(1, rules.run_words - rules.window + 1)
    return F.when(
        F.size(places) >= m,
        F.exists(F.sequence(F.lit(0), F.size(places) - m), lambda i: F.get(places, i + m - 1) - F.get(places, i) == m - 1),
    ).otherwise(False)


def _aligned(hits: DataFrame, rules: Decontamination) -> DataFrame:
    """Alignments that hold enough of an item: each diagonal, and each group of neighbouring ones."""
    pair = ["doc_id", "_x", "item_id", "_total", "_n"]
    diagonals = cut(
        hits.groupBy(*pair, (F.col("_p") - F.col("_q")).alias("_d"))
        .agg(F.sort_array(F.collect_set("_q")).alias("_qs"))  # of one item, so no longer than it
    )
    covers = F.col("n_windows") * 100 >= F.col("_total") * rules.min_percent
    single = diagonals.select(
        *pair, F.array(F.struct("_d", "_qs")).alias("_parts"), F.size("_qs").cast("long").alias("n_windows")
    ).where(covers | _has_run(F.get("_parts", F.lit(0))["_qs"], rules))
    # Copies of an item one after another are its length apart; half of that keeps them apart when they have gaps.
    order = Window.partitionBy(*pair).orderBy("_d")
    far = F.col("_d") - F.lag("_d").over(order) > F.col("_n") / 2
    grouped = diagonals.withColumn("_far", far.cast("int")).withColumn("_g", F.sum(F.coalesce("_far", F.lit(0))).over(order))
    # A window on several diagonals counts on that with the most windows.
    chosen = (
        grouped.select(*pair, "_g", "_d", F.size("_qs").alias("_m"), F.explode("_qs").alias("_q"))
        .groupBy(*pair, "_g", "_q")
        .agg(F.max_by("_d", F.struct("_m", "_d")).alias("_d"))
    )
    merged = (
        chosen.groupBy(*pair, "_g", "_d")
        .agg(F.sort_array(F.collect_list("_q")).alias("_qs"))
        .groupBy(*pair, "_g")
        .agg(F.collect_list(F.struct("_d", "_qs")).alias("_parts"), F.sum(F.size("_qs")).alias("n_windows"))
        .where((F.size("_parts") > 1) & covers)
    )
    return single.unionByName(merged.drop("_g"))


def _checked(aligned: DataFrame, rows: DataFrame, items: DataFrame, rules: Decontamination) -> DataFrame:
    """Keeps alignments whose slots are consistent; the best one for each document and item."""
    parts = F.aggregate("_parts", F.lit(0), lambda n, a: n + F.size(a["_qs"])) * 4 + 100
    few = broadcast_if_small(
        aligned.drop("_n").withColumnsRenamed({"doc_id": "_id", "_x": "_y"}), rules.broadcast_alignments, parts, rules.broadcast_bytes
    )
    texts = F.octet_length("_it") * 6 + 100  # the text, its words twice
    # Of the document only the words beside the item are kept, from place _from on.
    diagonals = F.transform("_parts", lambda a: a["_d"])
    left = cut(
        rows.join(few, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_y") == F.col("_x"))).drop("_id", "_x", "_y")
        .join(broadcast_if_small(items, rules.broadcast_alignments, texts, rules.broadcast_bytes), "item_id")
        .withColumns({"_d": F.array_min(diagonals), "_from": F.greatest(F.array_min(diagonals), F.lit(0))})
        .select(
            "doc_id", "item_id", "_total", "_d", "_parts", "n_windows", "_iw", "_from", "_ir",
            lower_words(F.slice(raw_words(_spaced(F.col("_t"))), F.col("_from") + 1, F.array_max(diagonals) + F.size("_iw") - F.col("_from"))).alias("_dr"),
        )
    )
    places, k = F.sequence(F.lit(0), F.size("_iw") - 1), F.least(F.size("_iw"), F.lit(rules.window))

    def slots(part: Column) -> Column:
        return F.transform(
            F.filter(
                places,
                lambda i: F.get("_iw", i).isin(NUM, NAME, UNIT) & F.exists(part["_qs"], lambda q: (q <= i) & (i < q + k)),
            ),
            lambda i: F.struct(
                F.get("_iw", i).alias("kind"),
                F.get("_ir", i).alias("item"),
                F.get("_dr", i + part["_d"] - F.col("_from")).alias("doc"),
            ),
        )

    def equal_windows(part: Column) -> Column:
        return F.filter(
            part["_qs"], lambda q: F.slice("_ir", q + 1, k) == F.slice("_dr", q + part["_d"] - F.col("_from") + 1, k)
        )

    pairs = left.withColumns(
        {"_s": F.array_distinct(F.flatten(F.transform("_parts", slots))), "_same": F.transform("_parts", equal_windows)}
    )
    # A function both ways: as many pairs as distinct values on either side.
    one_way = F.size(F.array_distinct(F.transform("_s", lambda s: F.struct(s["kind"], s["item"]))))
    other = F.size(F.array_distinct(F.transform("_s", lambda s: F.struct(s["kind"], s["doc"]))))
    enough = F.size(F.flatten("_same")) * 100 >= F.col("_total") * rules.min_percent
    same = enough | F.exists("_same", lambda qs: _has_run(qs, rules))
    kind = F.when(same, "verbatim").when((one_way == F.size("_s")) & (other == F.size("_s")), "reparameterised")
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.col("n_windows").desc(), "kind", "_d")
    return (
        pairs.withColumn("kind", kind)
        .where("kind is not null")
        .select("doc_id", "item_id", "n_windows", "_total", "kind", "_d")
        .distinct()
        .withColumn("_best", F.row_number().over(best))
        .where("_best = 1")
        .select("doc_id", "item_id", "n_windows", F.col("_total").cast("long").alias("item_windows"), "kind")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: Decontamination = Decontamination()) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    mark = fresh(docs, "_bad")
    bad = cut(contaminated(docs, benchmark, rules=rules).select(F.col("doc_id").alias(mark)).distinct())
    return docs.join(broadcast_if_small(bad), docs["doc_id"].eqNullSafe(F.col(mark)), "left_anti")
