"""Personal data by weak supervision.

Candidate spans come from loose patterns. Three kinds of labelers vote on each (yes, no, abstain): the
strict pattern of the kind, gazetteers, and the words and characters around. Expectation-maximisation
over the counts of vote patterns of all documents estimates how reliable each labeler is and how common
personal data is among the candidates of each kind; the resulting soft labels train a logistic span
classifier on the votes and on the span itself (its length, digits, capitals and variety of characters,
each by kind), which decides on every candidate. Spans of the four base kinds that pass their check are
personal data by definition and always stay.

Only counts of patterns leave the tasks: kind, votes and shape of a span, a bounded number whatever the
corpus.

Defined cases: a null or empty text has no spans; places are code points, ends exclusive; a candidate
that touches a base span or an earlier candidate is no span of its own; repeated rows are scanned
each; an empty table gives an empty result; other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.durable import fresh, in_batches, release, tidy

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name", "ssn")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: No digit before it: a match that fails at the first digit of a run fails at the others too.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"\(?(?<![0-9])[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])")
#: Area and exchange of a number without a country start with 2 to 9.
_NUMBERING_PLAN = re.compile(r"\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[.-][0-9]{4}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"[=:][ \t]?[\"']?([A-Za-z0-9_/+-]{20,})")
_NAME = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\. ((?:[A-Z][a-z]+)(?: [A-Z][a-z]+)?)")

#: Gazetteers. First names, endings of mail domains, issuers of cards, country codes.
FIRST_NAMES = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph "
    "jessica thomas sarah charles karen anna maria peter paul laura julia hans karl pierre jean marie jose juan luis carlos".split()
)
MAIL_ENDINGS = frozenset("com org net edu gov de fr es uk io co info eu ch at it nl".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
#: Words that speak for a kind when they stand shortly before, and words against any.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "payment", "iban", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "credential"),
    "name": ("contact", "patient", "author", "dear", "sincerely"),
    "ssn": ("ssn", "social security"),
}
AGAINST = ("version", "isbn", "issn", "figure", "section", "sha1", "sha256", "md5", "checksum", "commit")


@dataclass(frozen=True)
class PiiParams:
    #: Characters before a candidate in which context words are sought.
    context: int = 40
    threshold: float = 0.5
    em_steps: int = 50
    prior_votes: float = 10.0
    #: Share of a kind's candidates that are personal data, before any is seen; it weighs as ``prior_votes`` candidates.
    balance: float = 0.5
    #: The learned share stays this far from none and all, or no vote against a candidate would count.
    least_share: float = 0.2
    classifier_steps: int = 200


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so a long run of letters is walked once."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (free := m.end())
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """((start, end, kind) that pass, those that fail their check), of the base kinds."""
    good: list[tuple[int, int, str]] = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    bad: list[tuple[int, int, str]] = []
    if "." in text:
        for m in _IP.finditer(text):
            ok = all(len(q := p.lstrip("0")) < 4 and int(q or "0") <= 255 for p in m[0].split("."))
            (good if ok else bad).append((m.start(), m.end(), "ip"))
    for m in _DIGITS.finditer(text):
        n = m.end() - m.start()
        if n >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                (good if luhn(digits) else bad).append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            (good if 9 <= n <= 15 else bad).append((m.start(), m.end(), "phone"))
    return good, bad


def candidates(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans in order, other candidates in order)."""
    good, other = base_spans(text)
    if _ANY_DIGIT(text):
        other += [(m.start(), m.end(), "phone") for m in _LOCAL_PHONE.finditer(text)]
        other += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text)]
    other += [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    if ". " in text:
        other += [(*m.span(1), "name") for m in _NAME.finditer(text)]
    return sorted(good, key=_order), sorted(other, key=_order)


_ANY_DIGIT = re.compile(r"[0-9]").search
_order = lambda s: (s[0], KINDS.index(s[2]), s[1])


def votes(text: str, span: tuple[int, int, str], base: bool, params: PiiParams) -> tuple[int, int, int, int]:
    """Strict pattern, gazetteer, words before, characters around: 1 for, -1 against, 0 no opinion."""
    start, end, kind = span
    value = text[start:end]
    if kind in BASE_KINDS:
        strict = 1 if base or (kind == "phone" and _NUMBERING_PLAN.fullmatch(value)) else -1
    elif kind == "secret":
        strict = 1 if re.fullmatch(r"[0-9a-fA-F]{32,}", value) or (re.search("[0-9]", value) and re.search("[A-Za-z]", value)) else -1
    else:
        strict = 1
    if kind == "email":
        listed = 1 if value.rpartition(".")[2].lower() in MAIL_ENDINGS else 0
    elif kind == "card":
        listed = 1 if value.startswith(CARD_PREFIXES) else -1
    elif kind == "phone":
        listed = 1 if value[0] == "+" and value[1:].startswith(COUNTRY_CODES) else 0
    elif kind == "name":
        listed = 1 if value.split()[0].lower() in FIRST_NAMES else 0
    elif kind == "ip":
        listed = -1 if value.startswith(("0.", "127.", "255.")) else 0
    elif kind == "ssn":
        listed = -1 if value.startswith(("000", "666", "9")) else 0
    else:
        listed = 0
    before = text[max(0, start - params.context) : start].lower()
    said = -1 if any(w in before for w in AGAINST) else 1 if any(w in before for w in CONTEXT[kind]) else 0
    touches = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return strict, listed, said, -1 if touches else 1


#: Steps of the shape of a span: characters, and shares of digits, capitals and distinct characters in hundredths.
_LENGTHS, _DIGITS_SHARE, _CAPITALS, _VARIETY = (8, 12, 20, 32), (1, 40, 90), (1, 30), (30, 60)


def shape(value: str) -> tuple[int, int, int, int]:
    """The span itself: steps of its length, and of its shares of digits, capitals and distinct characters."""
    n = len(value)
    shares = (100 * sum(c.isdigit() for c in value) // n, 100 * sum(c.isupper() for c in value) // n, 100 * len(set(value)) // n)
    steps = ((n, _LENGTHS), *zip(shares, (_DIGITS_SHARE, _CAPITALS, _VARIETY)))
    return tuple(sum(x >= e for e in edges) for x, edges in steps)


_SHAPES = tuple(len(e) + 1 for e in (_LENGTHS, _DIGITS_SHARE, _CAPITALS, _VARIETY))
_WIDTH = 8 + len(KINDS) * (1 + sum(_SHAPES))


def _pattern(text: str, span: tuple[int, int, str], base: bool, params: PiiParams) -> str:
    """Kind, votes and shape of a candidate, as one word."""
    return " ".join(map(str, (span[2], *votes(text, span, base, params), *shape(text[span[0] : span[1]]))))


@dataclass(frozen=True)
class PiiModel:
    """The classifier, with what was learned of the labelers and of the kinds."""

    weights: np.ndarray
    reliability: np.ndarray
    share: dict[str, float]

    def probability(self, pattern: str) -> float:
        return float(1 / (1 + np.exp(-_features([pattern])[0] @ self.weights)))


def _features(patterns: list[str]) -> np.ndarray:
    """For each labeler whether it votes for and against; the kind; and the shape, by kind."""
    x = np.zeros((len(patterns), _WIDTH))
    for i, p in enumerate(patterns):
        kind, *v = p.split(" ")
        v = list(map(int, v))
        for j, vote in enumerate(v[:4]):
            x[i, 2 * j] = vote == 1
            x[i, 2 * j + 1] = vote == -1
        k = KINDS.index(kind)
        x[i, 8 + k] = 1
        at = 8 + len(KINDS) + k * sum(_SHAPES)
        for step, n in zip(v[4:], _SHAPES):
            x[i, at + step] = 1
            at += n
    return x


def train(counts: dict[str, int], params: PiiParams = PiiParams()) -> PiiModel:
    """EM over the labelers, then the classifier on its soft labels."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([[int(x) for x in p.split(" ")[1:5]] for p in patterns], int).reshape(-1, 4)
    kind = np.array([KINDS.index(p.split(" ")[0]) for p in patterns], int)
    # Chances of (against, no opinion, for) if the candidate is none, and if it is one. A labeler is
    # taken to be better than chance at first, the strict pattern more so than the others, and that
    # counts as ``prior_votes`` votes ever after.
    believed = np.array([[[0.8, 0.1, 0.1]] + [[0.5, 0.3, 0.2]] * 3, [[0.1, 0.1, 0.8]] + [[0.2, 0.3, 0.5]] * 3])
    chance, share = believed.copy(), np.full(len(KINDS), params.balance)
    soft = np.full(len(patterns), 0.5)
    seen = np.bincount(kind, n, len(KINDS))
    for _ in range(params.em_steps if len(patterns) else 0):
        like = np.stack([np.log(chance[c, np.arange(4), v + 1]).sum(axis=1) for c in (0, 1)])
        odds = np.log(share / (1 - share))[kind]
        soft = 1 / (1 + np.exp(like[0] - like[1] - odds))
        for c, w in ((0, n * (1 - soft)), (1, n * soft)):
            for j in range(4):
                got = np.bincount(v[:, j] + 1, w, 3) + params.prior_votes * believed[c, j]
                chance[c, j] = got / got.sum()
        share = (np.bincount(kind, n * soft, len(KINDS)) + params.prior_votes * params.balance) / (seen + params.prior_votes)
        share = np.clip(share, params.least_share, 1 - params.least_share)
    x = _features(patterns)
    # The labelers' own log-odds are where the classifier starts and what its small ridge pulls it to.
    odds = np.log(chance[1] / chance[0])
    start = np.zeros(_WIDTH)
    if patterns:  # where nothing was seen, nothing is held
        start[0:8:2], start[1:8:2] = odds[:, 2] - odds[:, 1], odds[:, 0] - odds[:, 1]
        start[8 : 8 + len(KINDS)] = np.log(share / (1 - share)) + odds[:, 1].sum()
    weights = start.copy()
    # Newton's method.
    for _ in range(params.classifier_steps if len(patterns) else 0):
        p = 1 / (1 + np.exp(-x @ weights))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(_WIDTH), x.T @ (n * (soft - p)) - (weights - start))
        weights = weights + np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    return PiiModel(weights, chance, {k: float(p) for k, p in zip(KINDS, share)})


def vote_counts(docs: DataFrame, text: str = "text", params: PiiParams = PiiParams()) -> dict[str, int]:
    """How often each pattern occurs, over all documents: kinds, votes and shapes bound their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    good, other = candidates(t)
                    total.update(_pattern(t, s, True, params) for s in good)
                    total.update(_pattern(t, s, False, params) for s in other)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["p", "n"])

    rows = in_batches(docs).select(F.col(text).alias("text")).mapInArrow(tidy(count), "p string, n long").groupBy("p").agg(F.sum("n"))
    return {r[0]: r[1] for r in rows.collect()}


class SpanFinder:
    """Finds the spans of a text; keeps the verdict on each vote pattern."""

    def __init__(self, model: PiiModel, params: PiiParams):
        self.model, self.params, self.known = model, params, {}

    def __call__(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(base spans, all spans), both in order."""
        if not text:
            return [], []
        good, other = candidates(text)
        if not other:
            return good, good
        taken, spans, k = 0, list(good), 0
        for s in other:
            while k < len(good) and good[k][0] < s[1]:
                taken = max(taken, good[k][1])
                k += 1
            if s[0] < taken:
                continue
            p = _pattern(text, s, False, self.params)
            if p not in self.known:
                self.known[p] = self.model.probability(p) >= self.params.threshold
            if self.known[p]:
                spans.append(s)
                taken = s[1]
        return good, sorted(spans, key=_order)


def span_string(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame, text: str = "text", id_column: str = "doc_id", params: PiiParams = PiiParams()) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans and their number."""
    model = train(vote_counts(docs, text, params), params)
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = SpanFinder(model, params)
        for batch in batches:
            n, digest, every, total = {k: [] for k in BASE_KINDS}, [], [], []
            for t in batch.column(1).to_pylist():
                good, spans = finder(t)
                for k in BASE_KINDS:
                    n[k].append(sum(s[2] == k for s in good))
                digest.append(hashlib.sha256(span_string(good).encode()).hexdigest())
                every.append(span_string(spans))
                total.append(len(spans))
            columns = [batch.column(0), *(pa.array(n[k], pa.int64()) for k in BASE_KINDS), pa.array(digest, pa.string()), pa.array(every, pa.string())]
            columns.append(pa.array(total, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), _OUT)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", params: PiiParams = PiiParams()) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; ``length`` is kept true if there."""
    model = train(vote_counts(docs, text, params), params)

    # Only the texts go to Python; the rows stay where they are.
    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        finder, out = SpanFinder(model, params), []
        for t in texts.to_pylist():
            parts, done = [], 0
            for a, b, k in finder(t)[1]:
                if a >= done:
                    parts += [t[done:a], f"[{k.upper()}]"]
                done = max(done, b)
            out.append("".join(parts) + t[done:] if parts else t)
        release()
        return pa.array(out, pa.string())

    mark = fresh(docs, "_clean")
    new = in_batches(docs).withColumn(mark, clean(F.col(text).cast("string")))
    columns = {text: F.col(mark)}
    if length in docs.columns:
        same = F.col(mark).eqNullSafe(F.col(text))
        columns[length] = F.when(same, F.col(length)).otherwise(F.length(mark)).cast(docs.schema[length].dataType)
    return new.withColumns(columns).drop(mark)
