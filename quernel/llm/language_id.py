"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 1- to 3-grams of the lower-cased text, with everything but letters as a space, hashed
into a fixed number of buckets. The model is a matrix of log probabilities (buckets by languages), a
few MB whatever the corpus, and is broadcast to the tasks, which score batches with numpy.

Training counts come from a bounded sample: about ``sample_per_language`` labelled documents of each
language outside the held-out fold, chosen by a hash of the id; of equal rows one. Whole texts are used. At most
``languages`` labels are learned, the most frequent ones.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null label teaches
nothing; without any labelled document every text is ``und``; ties go to the first language by name;
repeated rows are scored each; an empty table gives an empty result; other columns are ignored by
``predict`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.durable import in_batches, tidy

UNKNOWN = "und"
#: Characters worked on at a time.
CHUNK = 100_000


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: Log probabilities, languages by buckets and one more of zeros, for what is no n-gram.
    logp: np.ndarray
    prior: np.ndarray


@dataclass(frozen=True)
class LanguageIdParams:
    buckets: int = 1 << 16
    #: Documents that teach a language, about.
    sample_per_language: int = 4000
    #: Languages that are learned at most: the most frequent labels. The matrix has 256 KiB for each.
    languages: int = 256
    smoothing: float = 0.5
    #: The evidence of a text weighs as so many n-grams at most, so scores of long texts stay graded.
    evidence: int = 60


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points of the rows with non-letters as spaces, ends of the rows)."""
    first = 0
    while first < len(texts):
        rows, size = [], 0
        while first + len(rows) < len(texts) and (not rows or size < CHUNK):
            rows.append((texts[first + len(rows)] or "").lower() + "  ")
            size += len(rows[-1])
        codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(_letters()[codes], codes, np.uint32(32))
        yield first, codes, np.cumsum([len(r) for r in rows])
        first += len(rows)


def _grams(codes: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The bucket of the 1-, 2- and 3-gram that ends at each place; ``buckets`` where it has no letter.

    Two spaces end each row, so no n-gram holds letters of two rows.
    """
    letter = codes != 32
    c = codes.astype(np.uint32)
    out = []
    mixed = c * np.uint32(0x9E3779B1)
    part = mixed
    seen = letter
    for n in (1, 2, 3):
        if n > 1:
            back = np.full_like(c, 32)
            back[n - 1 :] = c[: len(c) - n + 1]
            part = (part ^ (part >> np.uint32(15))) * np.uint32(0x85EBCA77) + back * np.uint32(0xC2B2AE3D)
            # Of a longer n-gram one of the last two has to be a letter.
            seen = letter | np.concatenate(([False], letter[:-1]))
        h = part ^ (part >> np.uint32(13))
        h = (h * np.uint32(0x27D4EB2F + 2 * n)) >> np.uint32(16)
        out.append(np.where(seen, h % np.uint32(buckets), np.uint32(buckets)).astype(np.int64))
    return out


def _count(batches: Iterator[pa.RecordBatch], languages: list[str], buckets: int) -> Iterator[pa.RecordBatch]:
    place = {x: i for i, x in enumerate(languages)}
    total = np.zeros(len(languages) * (buckets + 1), np.int64)
    for batch in batches:
        langs = [place[x] for x in batch.column(1).to_pylist()]
        for first, codes, ends in _chunks(batch.column(0).to_pylist()):
            owner = np.repeat(np.array(langs[first : first + len(ends)], np.int64), np.diff(ends, prepend=0))
            for g in _grams(codes, buckets):
                total += np.bincount(owner * (buckets + 1) + g, minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])


def fit(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    id_column: str = "doc_id",
    params: LanguageIdParams = LanguageIdParams(),
) -> LanguageModel:
    """Learns from labelled documents outside the held-out fold."""
    rows = in_batches(docs).select(F.col(text).alias("text"), F.col(label).alias("lang"), F.col(id_column).alias("doc_id")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(params.languages)
    known = {r[0]: r[1] for r in frequent.collect()}
    languages, width = sorted(known), params.buckets + 1
    counts = np.zeros(len(languages) * width)
    if languages:
        draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
        share = F.create_map(*(F.lit(v) for x in languages for v in (x, params.sample_per_language / known[x])))
        # A row that is repeated teaches once, or it would outgrow the sample.
        drawn = rows.where(F.col("lang").isin(*languages)).where(draw < F.try_element_at(share, F.col("lang")))
        sample = drawn.dropDuplicates(["doc_id", "lang", "text"]).select("text", "lang")
        sums = (
            sample.mapInArrow(lambda it: _count(it, languages, params.buckets), "cell long, n long")
            .groupBy("cell")
            .agg(F.sum("n").alias("n"))
            .toArrow()  # languages times buckets at most
        )
        counts[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    counts = counts.reshape(len(languages), width) + params.smoothing
    counts[:, -1] = 0
    logp = np.log(np.maximum(counts, 1e-300) / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    logp[:, -1] = 0
    n = np.array([known[x] for x in languages], float)
    return LanguageModel(tuple(languages), logp.astype(np.float32), np.log(n / max(1.0, n.sum())))


def score_texts(texts: list[str | None], model: LanguageModel, params: LanguageIdParams) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, scores
    for first, codes, ends in _chunks(texts):
        starts = np.concatenate(([0], ends[:-1]))
        grams = _grams(codes, params.buckets)
        used = sum((np.add.reduceat((g < params.buckets).astype(np.int64), starts) for g in grams))
        fit_ = np.stack([sum(np.add.reduceat(row[g], starts, dtype=np.float64) for g in grams) for row in model.logp], 1)
        lettered = np.add.reduceat((codes != 32).astype(np.int64), starts) > 0
        fit_ = (fit_ + model.prior) / np.maximum(1.0, used / params.evidence)[:, None]
        fit_ -= fit_.max(axis=1, keepdims=True)
        best = fit_.argmax(axis=1)
        post = 1 / np.exp(fit_).sum(axis=1)
        for i in np.flatnonzero(lettered):
            names[first + i], scores[first + i] = model.languages[best[i]], post[i]
    return names, scores


def predict(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    params: LanguageIdParams = LanguageIdParams(),
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = in_batches(docs).select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score_texts(batch.column(len(keep)).to_pylist(), shared.value, params)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], names=out)

    out = [*keep, "lang_pred", "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(tidy(run), f"{schema}{', ' if schema else ''}lang_pred string, score double")


def identify(docs: DataFrame, params: LanguageIdParams = LanguageIdParams()) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    scored = predict(docs, fit(docs, params=params), params=params)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, params: LanguageIdParams = LanguageIdParams()) -> DataFrame:
    """The documents whose language is known, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, params=params))

    # Only the texts go to Python; the rows stay where they are.
    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        names, scores = score_texts(texts.to_pylist(), shared.value, params)
        return pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores)], pa.bool_())

    return in_batches(docs).where(known("text"))
