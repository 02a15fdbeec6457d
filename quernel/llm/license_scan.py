"""License scan by a positional index of rare words.

Templates of licence notices are indexed by their highest-IDF words: word -> (template, place). The IDF
is taken over all documents. For a text, each of its indexed words votes for (template, start); starts
near each other, as words put in or left out move them, that gather enough of the template's weight are a
candidate, which counts once the template's mandatory phrases stand where one of these starts has them. The base phrases are templates too: their rarest word finds every
place, and the phrase itself is what must be verified.

Defined cases: a null text is an empty text (no words, no labels, score 0); only A-Z is lower-cased;
overlapping and repeated notices count each; repeated rows are scanned each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.durable import in_batches

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

#: Phrases that always count, with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, notice, phrases of which all are mandatory. The notices are the licences' own words.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "associated documentation files")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "in compliance with the license")),
    ("apache", "spdx license identifier apache 2 0", ("spdx license identifier apache",)),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("gpl", "spdx license identifier gpl", ("spdx license identifier gpl",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license", "redistribute it and or modify")),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("mpl", "mozilla public license", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("epl", "eclipse public license", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies or substantial portions of the software",)),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("to deal in the software without restriction",)),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("the software is provided as is without warranty of any kind",)),
    ("mit", "license mit", ("license mit",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("is distributed on an as is basis",)),
    ("apache", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", ("each contributor hereby grants to you",)),
    ("apache", "apache 2 0", ("apache 2 0",)),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("in the hope that it will be useful",)),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ("a copy of the gnu general public license",)),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("verbatim copies of this license document",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license", "redistribute it and or modify")),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license", "redistribute it and or modify")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("to endorse or promote products derived from this software",)),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("by the copyright holders and contributors as is",)),
    ("bsd", "spdx license identifier bsd 3 clause", ("spdx license identifier bsd",)),
    ("bsd", "bsd 3 clause", ("bsd 3 clause",)),
    ("bsd", "bsd 2 clause", ("bsd 2 clause",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("subject to the terms of the mozilla public license",)),
    ("mpl", "spdx license identifier mpl 2 0", ("spdx license identifier mpl",)),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("the author disclaims all warranties with regard to this software",)),
    ("isc", "spdx license identifier isc", ("spdx license identifier isc",)),
    ("bsl", "boost software license version 1 0", ("boost software license",)),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy of the software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("will the authors be held liable for any damages",)),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("the origin of this software must not be misrepresented",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish use compile sell or distribute",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("made available under the terms of the eclipse public license",)),
    ("cddl", "common development and distribution license", ("common development and distribution license",)),
    ("artistic", "the artistic license 2 0", ("artistic license",)),
    ("cc0", "spdx license identifier cc0 1 0", ("spdx license identifier cc0",)),
)


@dataclass(frozen=True)
class LicenseScanParams:
    #: Words of a template that are indexed: the rarest.
    anchors: int = 6
    #: A start counts from this share of its template's anchor weight.
    min_share: float = 0.6
    #: Starts so many words apart are one, as words put in or left out move what follows. Base phrases stand as they are.
    slack: int = 4


@dataclass(frozen=True)
class _Template:
    label: str
    words: tuple[bytes, ...]
    #: (start in the template, words) of each mandatory phrase.
    mandatory: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; ``bytes.lower`` changes A-Z only."""
    return _WORDS((text or b"").lower())


def _templates() -> list[_Template]:
    out = []
    for phrase, label in BASE_PHRASES:
        words = tuple(phrase.encode().split())
        out.append(_Template(label, words, ((0, words),), True))
    for label, notice, phrases in NOTICES:
        words = tuple(notice.encode().split())
        found = []
        for p in phrases:
            part = tuple(p.encode().split())
            start = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            found.append((start, part))
        out.append(_Template(label, words, tuple(found), False))
    return out


def vocabulary() -> list[str]:
    return sorted({w.decode() for t in _templates() for w in t.words})


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Documents in all, and those that hold each licence word. One row per licence word comes back."""
    terms = frozenset(w.encode() for w in vocabulary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total.update(terms.intersection(words_of(t)))
                total[b""] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["w", "n"]
        )

    rows = in_batches(docs).select(F.col(text).cast("binary")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n"))
    found = {r[0]: r[1] for r in rows.collect()}
    return found.pop("", 0), found


class LicenseIndex:
    """The positional index, a few hundred postings."""

    def __init__(self, n_docs: int, df: dict[str, int], params: LicenseScanParams = LicenseScanParams()):
        self.params, self.templates = params, _templates()
        self.idf = {w.encode(): math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.weight = []
        for k, t in enumerate(self.templates):
            rare = sorted(range(len(t.words)), key=lambda i: (-self.idf[t.words[i]], i))
            rare = rare[: 1 if t.base else params.anchors]
            self.weight.append(sum(self.idf[t.words[i]] for i in rare))
            for i in rare:
                self.postings[t.words[i]].append((k, i))
        self.postings = dict(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """(Places of base phrases with labels, score of each label)."""
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(words):
            for k, at in self.postings.get(w, ()):
                votes[k].append((i - at, at))
        places, labels = [], {}
        for k, found in votes.items():
            t = self.templates[k]
            for low, high, anchors in self._runs(sorted(found), 0 if t.base else self.params.slack):
                share = min(1.0, sum(self.idf[t.words[at]] for at in anchors) / self.weight[k])
                if share < self.params.min_share and not t.base:
                    continue
                if all(any(self._stands(words, start + i, p) for start in range(low, high + 1)) for i, p in t.mandatory):
                    labels[t.label] = max(share, labels.get(t.label, 0.0))
                    if t.base:
                        places.append((low, t.label))
        return sorted(places), labels

    @staticmethod
    def _runs(found: list[tuple[int, int]], slack: int) -> Iterator[tuple[int, int, set[int]]]:
        """(first start, last start, anchors) of starts that follow each other by at most ``slack`` words."""
        low = high = None
        anchors: set[int] = set()
        for start, at in found:
            if high is not None and start - high > slack:
                yield low, high, anchors
                low = None
            if low is None:
                low, anchors = start, set()
            high = start
            anchors.add(at)
        if low is not None:
            yield low, high, anchors

    def _stands(self, words: list[bytes], at: int, phrase: tuple[bytes, ...]) -> bool:
        return at >= 0 and tuple(words[at : at + len(phrase)]) == phrase


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", params: LicenseScanParams = LicenseScanParams()
) -> DataFrame:
    """One row per document; see the module for what counts."""
    index = LicenseIndex(*document_frequencies(docs, text), params)
    schema = pa.schema(
        [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                places, labels = index.scan(words)
                ends = (places[0][0], places[-1][0]) if places else (None, None)
                base = ",".join(sorted({x for _, x in places}))
                rows.append((doc_id, len(words), len(places), *ends, base, ",".join(sorted(labels)), max(labels.values(), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, _OUT)
