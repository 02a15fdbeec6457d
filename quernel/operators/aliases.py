"""Aliases that a note's own words give: acronyms with what they stand for, and the parts of identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aliases of a note at most, the shortest one, and parts that say nothing.
MOST, SHORTEST = 24, 2
STOP_PARTS = frozenset("the and for with from that this not are was has had its into than then when what which will".split())
#: Patterns of acronyms and identifiers; fixed values.
BEHIND = re.compile(r"\(([A-Z][A-Z0-9]{1,7})\)")
BEFORE = re.compile(r"\b([A-Z][A-Z0-9]{1,7})\s*\(([^)]{2,80})\)", re.ASCII)
SNAKE = re.compile(r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b", re.ASCII)
CAMEL = re.compile(r"\b[a-z]+(?:[A-Z][a-z0-9]+)+\b|\b(?:[A-Z][a-z0-9]+){2,}\b", re.ASCII)
CODE = re.compile(r"`([^`\n]{1,80})`")
KEBAB = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)+")
WORD = re.compile(r"[A-Za-z][A-Za-z0-9]*")


def _letters(acronym: str) -> str:
    return "".join(c for c in acronym.lower() if c.isalpha())


def _spells(words: list[str], letters: str) -> bool:
    """Whether the words' initials hold the letters in order; small words may stand between."""
    initials = iter(w[0].lower() for w in words)
    return bool(letters) and all(c in initials for c in letters)


def acronym_pairs(text: str) -> Iterator[tuple[str, str]]:
    """(acronym, what it stands for) of ``AB (x y)``, then of ``x y (AB)``: there the shortest run of words before it, of
    at most two for each letter, whose initials spell it."""
    for m in BEFORE.finditer(text):
        if _spells(WORD.findall(m[2]), _letters(m[1])):
            yield m[1], m[2].strip()
    places = [m.start() for m in WORD.finditer(text)]
    ends = 0
    for m in BEHIND.finditer(text):
        while ends < len(places) and places[ends] < m.start():
            ends += 1
        letters = _letters(m[1])
        for n in range(len(letters), min(2 * len(letters), ends) + 1):
            phrase = text[places[ends - n] : m.start()].strip()
            if _spells(WORD.findall(phrase), letters):
                yield m[1], phrase
                break


def identifiers(text: str) -> Iterator[str]:
    """Snake and camel-case names anywhere, kebab-case ones in code spans only."""
    spans = (m[1].strip() for m in CODE.finditer(text))
    kebab = (s for s in spans if KEBAB.fullmatch(s))
    return iter(dict.fromkeys([*SNAKE.findall(text), *CAMEL.findall(text), *kebab]))


def parts(name: str) -> list[str]:
    """The parts of a compound name; none if it has one only."""
    found = [p for chunk in re.split("[_.-]+", name) if chunk for p in re.split(r"(?<=[^A-Z])(?=[A-Z])", chunk)]
    return found if len(found) > 1 else []


def note_aliases(title: str, body: str) -> list[str]:
    """The aliases of a note, each once whatever its case, in order, at most ``MOST``."""
    text = f"{title}\n{body}"
    every = [a for pair in acronym_pairs(text) for a in pair]
    every += [a for name in identifiers(text) for a in (name, *parts(name))]
    first: dict[str, str] = {}
    for a in map(str.strip, every):
        if len(a) >= SHORTEST and a.lower() not in STOP_PARTS:
            first.setdefault(a.lower(), a)
    return [a for _, a in sorted(first.items())][:MOST]


def _per_note(docs: DataFrame, title: str, body: str, key: str, kind: str, arrow: pa.DataType, name: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [make(t or "", b or "") for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=[key, name])

    own = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, title, body).mapInArrow(run, f"{key} {own}, {name} {kind}")


def derived_aliases(docs: DataFrame, title: str, body: str, key: str) -> DataFrame:
    """(key, aliases) of every note; null titles and bodies are empty, and a note without aliases has an empty list."""
    return _per_note(docs, title, body, key, "array<string>", pa.list_(pa.string()), "aliases", note_aliases)


def acronyms(docs: DataFrame, title: str, body: str, key: str) -> DataFrame:
    """(key, acronym, expansion): each pair of a note once."""
    kind = pa.list_(pa.struct([("acronym", pa.string()), ("expansion", pa.string())]))
    make = lambda t, b: [{"acronym": a, "expansion": e} for a, e in dict.fromkeys(acronym_pairs(f"{t}\n{b}"))]
    found = _per_note(docs, title, body, key, "array<struct<acronym:string,expansion:string>>", kind, "pairs", make)
    return found.select(key, F.inline("pairs"))


#: Fixed value: characters from which on an alias has to be answered for.
LEAST = 3


def derivable(alias: Column, source: Column, least: int = LEAST) -> Column:
    """Whether a source answers for an alias: it is part of it, its letters are initials of successive words, its own
    initials are a word there, or all its longer words stand there. Very short ones are; empty ones and nulls are not."""
    a, low = F.lower(F.trim(alias)), F.lower(source)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    initial = lambda w: F.regexp_extract(w, r"\p{L}", 0)
    initials = F.array_join(F.transform(words, lambda w: F.coalesce(F.nullif(initial(w), F.lit("")), F.lit("\x00"))), "")
    letters = F.regexp_replace(a, r"\P{L}", "")
    acronym = F.length(letters).between(2, 6) & F.contains(initials, letters)
    named = F.filter(F.split(a, r"\s+"), lambda w: w != "")
    own = F.array_join(F.transform(named, initial), "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^\P{L}+|\P{L}+$", ""))
    expansion = F.size(named).between(2, 6) & (F.length(own) >= 2) & F.array_contains(bare, own)
    pieces = F.filter(F.split(a, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    together = (F.size(pieces) > 1) & F.forall(pieces, lambda w: (F.length(w) < least) | F.contains(low, w))
    return F.coalesce((a != "") & ((F.length(a) < least) | F.contains(low, a) | acronym | expansion | together), F.lit(False))
