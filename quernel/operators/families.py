"""Families of equal and like notes, and contradictions among them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators import likeness
from quernel.operators.chunking import rows_of
from quernel.operators.loops import held


def exact_families(docs: DataFrame, text: str, key: str, created: str | None = None) -> DataFrame:
    """(fingerprint, size, canonical): families of two or more with equal normalised bodies. The canonical
    member is the earliest dated one, then the first by key."""
    order = F.struct(F.col(created).isNull(), F.col(created), F.col(key)) if created else F.struct(F.col(key))
    prints = docs.select(key, *([created] if created else []), X.fingerprint(F.col(text)).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.count("*").alias("size"), F.min_by(key, order).alias("canonical")).where("size >= 2")


def contradictions(docs: DataFrame, slug: str, text: str) -> DataFrame:
    """Slugs that stand for two or more different bodies."""
    g = docs.groupBy(slug).agg(F.count("*").alias("n"), F.count_distinct(X.fingerprint(F.col(text))).alias("bodies"))
    return g.where("n > 1 and bodies > 1")


#: Counts of characters that a body is first compared by; characters that share one make the bound weaker only.
_COUNTS = 64
#: Blocks of a class of lengths while these are of a bounded size.
_BLOCKS = 6


def _common(masks: dict[str, int], n: int, other: str) -> int:
    """The length of the longest common subsequence with a text of ``n`` characters, whose places ``masks`` holds as bits."""
    v = full = (1 << n) - 1
    for c in other:
        if m := masks.get(c):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


#: Bits of a word in the vectors of ``_prefixes``, one being left for the carry; the share of a body that is compared first, and some characters,
#: as unlike texts have differed enough by then; pairs that go through the vectors together, and those too few for it.
_BITS, _FIRST, _MORE, _TOGETHER, _FEW = 63, 0.35, 3, 8192, 256
_FULL = np.uint64((1 << _BITS) - 1)


def _prefixes(table: np.ndarray, codes: np.ndarray, base: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The longest common subsequence of each pair of prefixes, for many pairs at once: the bits of ``_common`` in words.
    ``table`` holds the places of each character by word, ``base`` where those of a pair's first text begin, ``codes``
    the characters of the second texts by place, and ``t``, from high to low, how many of them count."""
    rows = [np.full(len(j), _FULL) for _ in table]
    live = np.searchsorted(-t, -np.arange(t[0] if len(t) else 0))
    held = np.empty((3, len(j)), np.uint64)
    for place, m in enumerate(live.tolist()):
        at = base[:m] + codes[place].take(j[:m])
        u, total, carry = held[:, :m]
        carry[:] = 0
        for places, row in zip(table, rows):
            x = row[:m]
            places.take(at, out=u, mode="clip")
            u &= x
            np.add(x, u, out=total)
            total += carry
            np.right_shift(total, _BITS, out=carry)
            x ^= u
            total &= _FULL
            x |= total
    return _BITS * len(rows) - sum(np.bitwise_count(r).astype(np.int64) for r in rows)


def _possible(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs may still be alike after their first parts. A common subsequence of two texts is at most that of their
    first parts and the rest of either, if both leave a rest of the same length."""
    n, m = (np.array([len(x) for x in side]) for side in (left, right))
    first = np.minimum(n, np.ceil(n * _FIRST + _MORE).astype(np.int64))
    t = m[j] - (n - first)[i]
    kept = np.ones(len(i), bool)
    # Pairs of the same first texts go together, and texts of like lengths.
    order = np.lexsort((i, first[i]))
    order = order[t[order] > 0]
    if not len(order):
        return kept
    table = np.zeros((-(-int(first.max()) // _BITS), len(left) * _COUNTS), np.uint64)
    for k, codes in enumerate(left):
        at = np.arange(first[k])
        np.bitwise_or.at(table, (at // _BITS, k * _COUNTS + codes[: first[k]].astype(np.int64)), np.uint64(1) << (at % _BITS).astype(np.uint64))
    codes = np.zeros((int(m.max()), len(right)), np.uint8)
    for k, x in enumerate(right):
        codes[: len(x), k] = x
    for some in (order[at : at + _TOGETHER] for at in range(0, len(order), _TOGETHER)):
        some = some[np.argsort(-t[some])]
        a, b = i[some], j[some]
        words = -(-int(first[a].max()) // _BITS)
        most = _prefixes(table[:words], codes, a * _COUNTS, b, t[some]) + (n - first)[a]
        kept[some] = 2 * most >= least * (n[a] + m[b]) - 1e-9
    return kept


def _codes(bodies: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The codes of each body's characters, and their counts by body."""
    sizes = np.array([len(b) for b in bodies])
    flat = (np.frombuffer("".join(bodies).encode("utf-32-le"), "<u4") % _COUNTS).astype(np.uint8)
    counts = np.bincount(np.repeat(np.arange(len(bodies)) * _COUNTS, sizes) + flat, minlength=len(bodies) * _COUNTS)
    return np.split(flat, np.cumsum(sizes)[:-1]), counts.reshape(-1, _COUNTS)


def _alike(left: pd.DataFrame, right: pd.DataFrame, same: bool, least: float) -> Iterator[tuple]:
    """(first key, second key, ratio) of bodies of two blocks. Bounds on the matched characters come first: those that
    both have, then those of the longest common subsequence, of the first parts and of all; what is left meets the
    matcher."""
    if not len(left) or not len(right):
        return
    codes, counts = zip(*(_codes(x["body"].tolist()) for x in (left, right)))
    pairs = likeness.near(*counts, least)
    pairs = np.triu(pairs, 1) if same else pairs
    pairs = likeness.by_first_steps(left["body"].tolist(), right["body"].tolist(), left["key"].to_numpy()[:, None] > right["key"].to_numpy(), pairs, least)
    i, j = np.nonzero(pairs)
    keep = np.ones(len(i), bool)
    if len(i) >= _FEW:
        used, at = zip(*(np.unique(x, return_inverse=True) for x in (i, j)))
        keep = _possible(*([side[x] for x in some] for side, some in zip(codes, used)), *at, least)
    keys, bodies = ([x[c].tolist() for x in (left, right)] for c in ("key", "body"))
    masks: dict[str, int] = {}
    last = -1
    for i, j in zip(i[keep].tolist(), j[keep].tolist()):
        (key, body), (other, text) = (keys[0][i], bodies[0][i]), (keys[1][j], bodies[1][j])
        if i != last:
            masks, last = {}, i
            for place, c in enumerate(body):
                masks[c] = masks.get(c, 0) | 1 << place
        if 2 * _common(masks, len(body), text) < least * (len(body) + len(text)) - 1e-9:
            continue
        # The matcher's result depends on the order of the two: the earlier note is the first.
        a, b = ((key, body), (other, text)) if key < other else ((other, text), (key, body))
        ratio = SequenceMatcher(None, a[1], b[1], autojunk=False).ratio()
        if ratio >= least:
            yield a[0], b[0], ratio


def _pieces(left: pd.DataFrame, right: pd.DataFrame, same: bool, least: float, block: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, bool]]:
    """Parts of two blocks, by about ``block`` rows of like lengths, that have to meet, and whether they are one part."""
    sides = []
    for side in [left] if same else [left, right]:
        side = side.iloc[np.argsort(side["body"].str.len().to_numpy(), kind="stable")]
        cuts = np.linspace(0, len(side), max(1, round(len(side) / block)) + 1).astype(int)
        sides.append([side.iloc[x:y] for x, y in zip(cuts, cuts[1:]) if x < y])
    for i, a in enumerate(sides[0]):
        for b in sides[0][i:] if same else sides[1]:
            (low, high), (under, over) = ((len(x["body"].iloc[0]), len(x["body"].iloc[-1])) for x in (a, b))
            if (2 - least) * high >= least * under - 1e-9 and (2 - least) * over >= least * low - 1e-9:
                yield a, b, a is b


def _bodies(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(body, key): each normalised body with the first note that has it."""
    rows = docs.select(F.col(key).alias("key"), X.normalised_body(F.col(text)).alias("body")).where("body is not null")
    return rows.groupBy("body").agg(F.min("key").alias("key"))


def like_pairs(docs: DataFrame, text: str, key: str, least: float = 0.85, block: int = 512) -> DataFrame:
    """(a, b, ratio) of notes whose normalised bodies are at least ``least`` alike but not equal, a before b. Notes of
    one body are one, by the first of them.

    The ratio is twice the matched characters by all characters, so of two alike bodies the shorter one has
    at least least / (2 - least) of the other's length: notes of the same or the next class of lengths meet.
    A class is split into blocks, and a task compares two blocks, ``block`` rows of each at a time. Blocks of large classes have
    up to eight times as many rows, so a text goes to few tasks. That is the square of a class in cheap
    bounds, taken for many pairs at once; no index on parts of the texts is exact at ratios like 0.85, where a difference every seventh character
    is allowed. For large collections of long texts use a join on shingles.
    """
    rows = _bodies(docs, text, key)
    step = math.log((2 - least) / least)
    rows, _ = held(rows.withColumn("band", F.floor(F.log(F.greatest(F.length("body"), F.lit(1)).cast("double")) / step).cast("int")), 0)
    # As many rows as there are classes of lengths, a hundred at most.
    size = lambda n: min(max(block, -(-n // _BLOCKS)), 8 * block)
    blocks = {r["band"]: -(-r["count"] // size(r["count"])) for r in rows.groupBy("band").count().collect()}
    if not blocks:
        return rows.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("ratio"))
    of = F.create_map(*(F.lit(x) for b, n in blocks.items() for x in (b, n)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.try_element_at(of, F.col("band"))).cast("int"))
    # A body meets its own class, as either block of a pair of these, and the blocks of the class above.
    mine = F.explode(F.sequence(F.lit(0), F.try_element_at(of, F.col("band")) - 1)).alias("other")
    inner = rows.select("key", "body", "band", "own", mine).select(
        "key", "body", F.col("band").alias("low"), F.col("band").alias("high"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))
    many = lambda band: F.coalesce(F.try_element_at(of, band), F.lit(0))
    facing = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    up, down = F.col("band") + 1, F.col("band") - 1
    upper = rows.select("key", "body", F.col("band").alias("low"), up.alias("high"), F.col("own").alias("i"), facing(many(up)).alias("j"), F.lit(True).alias("left"))
    lower = rows.select("key", "body", down.alias("low"), F.col("band").alias("high"), facing(many(down)).alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        same = rows["low"].iloc[0] == rows["high"].iloc[0] and rows["i"].iloc[0] == rows["j"].iloc[0]
        left = rows[rows["left"]]
        pieces = _pieces(left, left if same else rows[~rows["left"]], same, least, block)
        return pd.DataFrame([x for a, b, own in pieces for x in _alike(a, b, own, least)], columns=["a", "b", "ratio"])

    kind = docs.schema[key].dataType.simpleString()
    # A number of tasks of its own, as blocks are small rows for long work and would else be put together.
    meetings = sum(n * (n + 1) // 2 + n * blocks.get(b + 1, 0) for b, n in blocks.items())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(meetings, 4000))
    pairs = inner.unionByName(upper).unionByName(lower).repartition(tasks, "low", "high", "i", "j").groupBy("low", "high", "i", "j")
    return pairs.applyInPandas(compare, f"a {kind}, b {kind}, ratio double")


def like_groups(docs: DataFrame, text: str, key: str, least: float = 0.85) -> DataFrame:
    """(key, hub, ratio): each note with the hub of its group, in order of key. A note is a hub unless it is like
    an earlier hub; else it belongs to the first of these. A note without text is a hub; keys are unique.

    A note is decided once all earlier notes like it are, so rounds go on until all are.
    """
    firsts, _ = held(_bodies(docs, text, key))
    # Few rows of many tasks, which each round would go through again.
    pairs, _ = held(like_pairs(docs, text, key, least).repartition("b"))
    notes = firsts.select("key")
    state = notes.join(pairs.select(F.col("b").alias("key")).distinct(), "key", "left_anti").withColumn("is_hub", F.lit(True))
    state, n = held(state)
    while True:
        known = pairs.join(state.withColumnRenamed("key", "a"), "a", "left")
        told = known.groupBy(F.col("b").alias("key")).agg(
            F.bool_or(F.coalesce("is_hub", F.lit(False))).alias("_follows"), F.bool_and(~F.coalesce("is_hub", F.lit(True))).alias("_free")
        )
        new = told.where("_follows or _free").join(state, "key", "left_anti").select("key", (~F.col("_follows")).alias("is_hub"))
        before, (state, n) = n, held(state.unionByName(new))
        if n == before:
            break
    hubs = state.where("is_hub")
    joined = pairs.join(hubs.select(F.col("key").alias("a")), "a", "left_semi").join(state.where("not is_hub").select(F.col("key").alias("b")), "b", "left_semi")
    members = joined.groupBy("b").agg(F.min_by(F.struct("a", "ratio"), "a").alias("m")).select(F.col("b").alias("key"), F.col("m.a").alias("hub"), "m.ratio")
    decided = hubs.select("key", F.col("key").alias("hub"), F.lit(1.0).alias("ratio")).unionByName(members)
    # What has the body of an earlier note goes where that went.
    copies = docs.select(F.col(key).alias("key"), X.normalised_body(F.col(text)).alias("body")).where("body is not null").distinct()
    first = copies.join(firsts.withColumnRenamed("key", "first"), "body").select("key", "first").join(decided.withColumnRenamed("key", "first"), "first")
    bare = docs.where(F.col(text).isNull()).select(F.col(key).alias("key"), F.col(key).alias("hub"), F.lit(1.0).alias("ratio"))
    return first.select("key", "hub", "ratio").unionByName(bare)


def tfidf_pairs(docs: DataFrame, tokens_text: str, key: str, least: float, min_df: int = 2, max_share: float = 0.5) -> DataFrame:
    """(a, b, score) of notes whose TF-IDF vectors are at least ``least`` alike.

    Terms within a band of document frequency are weighted (1 + ln tf) * (ln((n+1)/(df+1)) + 1) and the
    vectors brought to length one. Pairs meet on rare terms only: a note's most frequent terms, together shorter than
    ``least``, can't make a pair alone, and of two notes that are alike the rarest shared term is among the others of
    both. What has met is then scored on all its terms.
    """
    t = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(tokens_text)), F.lit("[a-z][a-z0-9]{2,}"), 0)).alias("term"))
    tf = t.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.count()
    cap = int(max_share * n)
    cap = cap if cap >= min_df else n
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(min_df, cap))
    w = tf.join(df, "term").select(key, "term", "df", ((1 + F.ln("tf")) * (F.ln((n + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    unit, _ = held(w.join(length, key).select(key, "term", "df", (F.col("w") / F.col("len")).alias("w")), 0)
    often = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = unit.withColumn("_sum", F.sum(F.col("w") * F.col("w")).over(often)).where(F.col("_sum") >= least * least - 1e-9).select(key, "term")
    met = rare.toDF("a", "term").join(rare.toDF("b", "term"), "term").where("a < b").select("a", "b").distinct()
    a, b = (unit.select(F.col(key).alias(side), "term", F.col("w").alias(f"w{side}")) for side in "ab")
    scored = met.join(a, "a").join(b, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))
    return scored.where(F.col("score") >= least)


def snippets(hits: DataFrame, text: str, terms: str, width: int = 24) -> DataFrame:
    """The window of ``width`` words that holds most of the terms, for surviving hits only, hits in brackets."""

    @F.pandas_udf("string")
    def best(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(t: str | None, w) -> str:
            words = (t or "").split()
            asked = set(w)
            hot = [x.lower().strip(".,;:!?()") in asked for x in words]
            score, top, at = sum(hot[:width]), sum(hot[:width]), 0
            for i in range(width, len(words)):
                score += hot[i] - hot[i - width]
                if score > top:
                    top, at = score, i - width + 1
            shown = [f"[{x}]" if h else x for x, h in zip(words[at : at + width], hot[at : at + width])]
            return ("… " if at else "") + " ".join(shown) + (" …" if at + width < len(words) else "")

        return pd.Series([one(t, w) for t, w in zip(texts, wanted)])

    return hits.withColumn("snippet", best(text, terms))


def chunks(docs: DataFrame, text: str, key: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, chunk_idx, content): whole paragraphs while they fit into ``size`` characters together; a paragraph
    above it is cut into slices of ``size`` that overlap. Each chunk but the first begins with the last
    ``overlap`` characters of the chunk before, as it was cut. A text without paragraphs is one chunk, an empty or
    null one too.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.filter(F.split(body, "\n\n"), lambda p: p.rlike(r"\S"))
    starts = lambda p: F.sequence(F.lit(0), F.length(p) - 1, F.lit(max(1, size - overlap)))
    unit = lambda t, whole: F.struct(t.alias("t"), F.lit(whole).alias("whole"))
    units = F.transform(
        "_p",
        lambda p: F.when(F.length(p) <= size, F.array(unit(p, True))).otherwise(
            F.transform(starts(p), lambda i: unit(F.substring(p, i + 1, F.lit(size)), False))
        ),
    )

    def put(s: Column, u: Column) -> Column:
        """The chunk that grows, and those that are done."""
        now = s["now"]
        joins = u["whole"] & F.coalesce(now["whole"], F.lit(False)) & (F.length(now["t"]) + F.length(u["t"]) + 2 <= size)
        grown = F.struct(F.concat(now["t"], F.lit("\n\n"), u["t"]).alias("t"), F.lit(True).alias("whole"))
        done = F.when(joins | now["t"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(now["t"])))
        return F.struct(F.when(joins, grown).otherwise(u).alias("now"), done.alias("done"))

    none = F.struct(F.lit(None).cast("struct<t:string,whole:boolean>").alias("now"), F.array().cast("array<string>").alias("done"))
    # Each step is a projection of its own, so none is worked out again for every chunk.
    made = docs.select(key, F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.array(body)).alias("_p"))
    made = made.select(key, F.aggregate(F.flatten(units), none, put).alias("_f"))
    made = made.select(key, F.posexplode(F.concat("_f.done", F.array("_f.now.t"))).alias("chunk_idx", "_c"), F.col("_f.done").alias("_done"))
    before = F.get("_done", F.col("chunk_idx") - 1)
    tail = F.substring(before, F.greatest(F.length(before) - overlap + 1, F.lit(1)), F.lit(overlap))
    return made.select(key, "chunk_idx", F.concat(F.coalesce(tail, F.lit("")), "_c").alias("content"))


def header_chunks(docs: DataFrame, raw: str, key: str) -> DataFrame:
    """(key, chunk_idx, header_path, content): sections by headings outside fences, with their ancestors."""

    def sections(text: str) -> Iterator[tuple[int, str, str]]:
        path: list[tuple[int, str]] = []
        lines: list[str] = []
        n, fenced = 0, False
        for line in [*text.split("\n"), None]:
            if line is not None and line.startswith("```"):
                fenced = not fenced
            level = 0 if line is None or fenced else len(line) - len(line.lstrip("#"))
            title = line[level:].strip() if line and 1 <= level <= 6 and line[level : level + 1] == " " else ""
            if line is None or title:
                if any(x.strip() for x in lines):
                    yield n, " > ".join(h for _, h in path), "\n".join(lines).strip()
                    n += 1
                lines = []
                if title:
                    path = [p for p in path if p[0] < level] + [(level, title)]
            else:
                lines.append(line)

    return rows_of(docs, [raw], key, "chunk_idx int, header_path string, content string", sections)
