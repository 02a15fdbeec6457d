"""Source divergence audit: how far the terms of each source of a language are from the others' and from the language's.

Texts go through tasks as Arrow buffers: a lookup table over the bytes of many texts at once finds where terms begin and
end, slices are grouped by xxhash, and every slice is compared byte by byte with the first of its group. Spark sums
the counts by (language, source, term). Frequencies are integers out of 10**9 and all arithmetic is exact.

The sum of a pair of sources runs over all kept terms, but most counts are zero. With p(c) of a count c, and 0 for count
zero, ``sum f(pa, pb)`` is ``V f(a0, b0)``, plus what a's terms add against ``b0``, plus what b's terms add against
``a0`` (both from histograms of counts), plus a correction for terms that both have. Only the last meets both
sources: terms are dealt in blocks, each task holds a block as a CSR matrix (sources by terms), and for one row of it
at a time the differences to all others are summed by reduceat.

Nulls in text, lang or source are empty strings. A group without terms has its rows of part ``pair``; a language
without kept terms has pairs of value 0. Repeated documents count again. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quernel.llm.arrays import text_chunks
from quernel.llm.durable import broadcast_if_small, cut, in_batches, tidy


@dataclass(frozen=True)
class DivergenceParams:
    #: Documents of a language that must have a term.
    min_docs: int = 3
    scale: int = 1_000_000_000
    #: Terms of a group that are reported.
    top: int = 200
    #: Counts of kept terms by source that a task holds at once, about.
    block: int = 200_000


#: Letters and all bytes beyond ASCII belong to terms.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each) of the terms in the bytes of texts that lie one after another."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(different slices of ``data``, which of them each slice is): grouped by xxhash, then told apart byte by byte."""
    buffer = data.tobytes()
    hashes = np.fromiter((xxh64_intdigest(buffer[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    length = ends - starts
    heads = first[group]
    alike = length == length[heads]
    # Bytes of the slices as long as their group's first, beside the bytes of that.
    at = np.flatnonzero(alike)
    size = length[at]
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    differ = data[np.repeat(starts[at], size) + inner] != data[np.repeat(starts[heads[at]], size) + inner]
    alike[np.repeat(at, size)[differ]] = False
    pieces = [buffer[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
    # What shares a hash and no more gets groups of its own.
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~alike).tolist():
        piece = buffer[starts[i] : ends[i]]
        if piece not in others:
            others[piece] = len(pieces)
            pieces.append(piece)
        group[i] = others[piece]
    return pieces, group


_COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, in parts that are still
    to be summed. A row without a term stands for each group."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, sources = batch.columns
            for row, data, offsets in text_chunks(texts, 1 << 22):
                names = list(zip(langs.slice(row, len(offsets) - 1).to_pylist(), sources.slice(row, len(offsets) - 1).to_pylist()))
                codes: dict = {}
                group = np.array([codes.setdefault(n, len(codes)) for n in names], np.int64)
                pairs = list(codes)
                yield _counts([(*pair, None, 0, 0) for pair in pairs])
                starts, ends, at = terms(data, offsets)
                if not len(starts):
                    continue
                pieces, term = grouped(_LOWER[data], starts, ends)
                # Once for each document and term, then by group.
                key, times = np.unique(at * len(pieces) + term, return_counts=True)
                key, inverse = np.unique(group[key // len(pieces)] * len(pieces) + key % len(pieces), return_inverse=True)
                total, held = np.bincount(inverse, times).astype(np.int64), np.bincount(inverse)
                for k in range(0, len(key), 1 << 16):
                    some = slice(k, k + (1 << 16))
                    g, w = key[some] // len(pieces), key[some] % len(pieces)
                    langs_, sources_ = ([pairs[i][side] for i in g.tolist()] for side in (0, 1))
                    words = pa.array([pieces[i] for i in w.tolist()], pa.binary()).cast(pa.string())
                    columns = [pa.array(langs_, pa.string()), pa.array(sources_, pa.string()), words, pa.array(total[some]), pa.array(held[some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return in_batches(docs.select(empty("text"), empty("lang"), empty("source"))).mapInArrow(tidy(give), _COUNTS)


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "source", "term", "n", "docs"])


def _frequency(n: str, total: str, p: DivergenceParams) -> Column:
    """1 + floor(scale * (n + 1) / total), exact beyond 64 bits; a language without kept terms has total 0."""
    wide = f"CAST({p.scale} AS DECIMAL(12, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))"
    return F.expr(f"1 + {wide} div CAST(greatest({total}, 1) AS DECIMAL(20, 0))")


def _against(p: str, q: str) -> Column:
    """The difference of frequency ``p`` from ``q``."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _shared(table: pa.Table) -> pa.Table:
    """Of one block of terms: for each two sources that share some, what the shared terms add to the pair beyond what
    either's terms add alone."""
    source = table.column("source").combine_chunks().dictionary_encode()
    row, names = source.indices.to_numpy().astype(np.int64), source.dictionary
    order = np.argsort(row, kind="stable")
    row = row[order]
    column = table.column("term").combine_chunks().dictionary_encode()
    at, width = column.indices.to_numpy().astype(np.int64)[order], len(column.dictionary)
    p, zero = (table.column(c).to_numpy()[order] for c in ("p", "p0"))
    # CSR: the entries of source i are those from heads[i] up to heads[i + 1].
    heads = np.searchsorted(row, np.arange(len(names) + 1))
    f = lambda p, q: (p - q) * (p - q) // q
    left, right, value = [], [], []
    mine = np.zeros(width, np.int64)
    for i in range(len(names)):
        own = slice(heads[i], heads[i + 1])
        mine[at[own]] = p[own]
        pa_, zero_a = mine[at], zero[heads[i]]
        both = np.flatnonzero(pa_)
        extra = np.zeros(len(at), np.int64)
        a, b, zero_b = pa_[both], p[both], zero[both]
        extra[both] = f(a, b) - f(a, zero_b) - f(zero_a, b) + f(zero_a, zero_b)
        sums = np.add.reduceat(extra, heads[:-1])
        met = np.flatnonzero(sums)
        left.append(np.full(len(met), i))
        right.append(met)
        value.append(sums[met])
        mine[at[own]] = 0
    left, right = np.concatenate(left), np.concatenate(right)
    lang = pa.array([table.column("lang")[0].as_py()] * len(left), pa.string())
    columns = [lang, names.take(pa.array(left)).cast(pa.string()), names.take(pa.array(right)).cast(pa.string()), pa.array(np.concatenate(value))]
    return pa.Table.from_arrays(columns, names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, p: DivergenceParams = DivergenceParams()) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds each other source of the language, part ``term``
    the ``top`` terms that the group has more often than the language."""
    counts = cut(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    same = Window.partitionBy("lang", "term")
    kept = counts.where("term IS NOT NULL").select(
        "lang", "source", "term", "n", F.sum("n").over(same).alias("lang_n"), F.sum("docs").over(same).alias("held"),
        (F.row_number().over(same.orderBy("source")) == 1).alias("head"))
    kept = cut(kept.where(F.col("held") >= p.min_docs).drop("held"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("head").alias("heads"), F.count("*").alias("entries"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0)
    of = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "n", F.sum("heads").over(of).alias("kept"), F.sum("n").over(of).alias("lang_n"),
                           F.sum("entries").over(of).alias("entries"))
    groups = groups.select("lang", "source", "kept", "entries", (F.col("n") + F.col("kept")).alias("total"), (F.col("lang_n") + F.col("kept")).alias("lang_total"))
    groups = cut(groups.withColumn("n", F.lit(0)).withColumn("p0", _frequency("n", "total", p)).drop("n"))
    size = F.octet_length("lang") + F.octet_length("source") + 40
    entries = kept.join(broadcast_if_small(groups, 200_000, size), ["lang", "source"]).select(
        "lang", "source", "term", _frequency("n", "total", p).alias("p"), _frequency("lang_n", "lang_total", p).alias("q"), "p0", "entries")
    return _pairs(groups, entries, p).unionByName(_terms(entries, p))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _terms(entries: DataFrame, p: DivergenceParams) -> DataFrame:
    found = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _against("p", "q").alias("value"))
    return _ranked(found).where(F.col("rank") <= p.top)


def _pairs(groups: DataFrame, entries: DataFrame, p: DivergenceParams) -> DataFrame:
    mine = groups.select("lang", "source", "kept", F.col("p0").alias("a0"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    pairs = mine.join(others, "lang").where("source <> item")
    times = entries.groupBy("lang", "source", "p").count()
    exact = lambda n, value: (F.col(n).cast("decimal(19,0)") * value.cast("decimal(19,0)")).alias("value")
    none = pairs.select("lang", "source", "item", exact("kept", _against("a0", "b0")))
    # What the terms of one side add, where the other has none of them.
    a = pairs.join(times, ["lang", "source"])
    a = a.select("lang", "source", "item", exact("count", _against("p", "b0") - _against("a0", "b0")))
    b = pairs.join(times.withColumnRenamed("source", "item"), ["lang", "item"])
    b = b.select("lang", "source", "item", exact("count", _against("a0", "p") - _against("a0", "b0")))
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("entries") / p.block)).cast("int").alias("block")
    blocks = entries.select("lang", "source", "term", "p", "p0", block).groupBy("lang", "block")
    both = blocks.applyInArrow(_shared, "lang string, source string, item string, value long").where("source <> item")
    all_ = none.unionByName(a).unionByName(b).unionByName(both.withColumn("value", F.col("value").cast("decimal(38,0)")))
    total = all_.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    return _ranked(total.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
