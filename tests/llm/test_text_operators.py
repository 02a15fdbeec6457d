"""License scan, language identification, PII, quality rules and LM scoring against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from quernel.llm import license_scan
from quernel.llm.language_id import LanguageIdParams, identify, keep_identified
from quernel.llm.license_scan import scan_licenses
from quernel.llm.lm_score import LmParams, learn_weights, score_documents
from quernel.llm.pii import PiiParams, find, luhn, redact, train
from quernel.llm.quality_rules import QualityRules, document_counts, quality_report

LONG = "lorem ipsum dolor " * 40_000


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- op 1


def test_license_scan(make):
    texts = [
        None, "", "Released under the MIT License. MIT license", "mit-license and GENERAL public\nlicense", "the general public licenses", "Kein Éapache license",
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU Lesser General Public License", "public license general", "apache license " * 500 + LONG,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the)",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = scan_licenses(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r.doc_id]))
        places = sorted((i, x) for p, x in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r.labels for r in got}
    assert by[6] == "cc-by-nc" and "lgpl" in by[7].split(",") and by[8] == "" and by[10] == "mit" and by[0] == ""
    assert scan_licenses(make([])).collect() == []


def test_license_notices_with_changes(make):
    rows = [
        (1, "Permission is hereby granted, free of charge, to any natural person obtaining a copy of this software and associated documentation files"), (2, "License: MIT"), (3, "see Apache-2.0"),
        (4, "SPDX-License-Identifier: BSD-3-Clause"), (5, "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
        (6, "Distributed under the Boost Software License, Version 1.0."), (7, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
        (8, "the software of the person is free and the rights to use a copy are included in the documentation"), (9, "Redistributions of source code must always retain the above copyright notice, this list of conditions and the following disclaimer."),
        (10, "x " * 300 + "The above copyright notice and this very permission notice shall be included in all copies or substantial portions of the Software. " + "y " * 300),
    ]
    got = {r.doc_id: r.labels for r in scan_licenses(make(rows)).collect()}
    assert got == {1: "mit", 2: "mit", 3: "apache", 4: "bsd", 5: "bsd", 6: "bsl", 7: "zlib", 8: "", 9: "", 10: "mit"}


def test_added_labels_equal_a_scan_of_all_places(make):
    """Every label by trying each notice at each place, with the votes of its rarest words counted anew."""
    rnd = random.Random(12)
    notices = [n for _, n, _ in license_scan.NOTICES]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(1, 4)):
            part = rnd.choice(notices).split()
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(part) + 1)
                part[at:at] = [rnd.choice(("extra", "license", "software"))] if rnd.random() < 0.6 else []
                if rnd.random() < 0.3 and part:
                    part.pop(rnd.randrange(len(part)))
            words += part + [f"w{rnd.randrange(50)}" for _ in range(rnd.randint(0, 12))]
        texts.append(" ".join(words))
    docs = make(list(enumerate(texts)))
    index = license_scan.LicenseIndex(*license_scan.document_frequencies(docs))
    want = {}
    for i, text in enumerate(texts):
        words, labels = [w.encode() for w in text.split()], set()
        for k, t in enumerate(index.templates):
            anchors = {at for posts in index.postings.values() for j, at in posts if j == k}
            starts = sorted({p - at for at in anchors for p, w in enumerate(words) if w == t.words[at]})
            groups = []
            for x in starts:
                if groups and x - groups[-1][-1] <= (0 if t.base else 4):
                    groups[-1].append(x)
                else:
                    groups.append([x])
            for g in groups:
                held = {at for at in anchors for x in g if 0 <= x + at < len(words) and words[x + at] == t.words[at]}
                enough = sum(index.idf[t.words[at]] for at in held) >= 0.6 * index.weight[k] - 1e-12
                near = range(g[0], g[-1] + 1)
                if (t.base or enough) and all(any(x + o >= 0 and tuple(words[x + o : x + o + len(p)]) == p for x in near) for o, p in t.mandatory):
                    labels.add(t.label)
        want[i] = ",".join(sorted(labels))
    assert {r.doc_id: r.labels for r in scan_licenses(docs).collect()} == want
    assert sum(bool(x) for x in want.values()) > 50


# --- op 4


def test_language_id(make):
    parts = {"en": "the of and ing tion with that this", "de": "der die und ung schaft mit das ein", "fr": "le la les des tion avec une qui éa"}
    rows = [(i, " ".join((parts[g] + " ").split()[(i + k) % 8] for k in range(30)), g, "s") for i, g in enumerate(["en", "de", "fr"] * 40)]
    odd = [(900, None, "en", "s"), (901, "123 ... !!", "de", "s"), (902, "the and with", None, "s"), (903, "", None, None), (904, LONG, None, "s"), (None, "der und", "de", "s")]
    docs = make(rows + odd)
    got = {r.doc_id: r for r in identify(docs).collect()}
    for i, _, g, _ in rows:
        assert got[i].lang_pred == g and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [got[i].lang_pred for i in (900, 901, 903)] == ["und"] * 3 and got[902].lang_pred == "en" and got[904].lang_pred in parts
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert {900, 901, 903}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() >= 121
    assert identify(make([])).collect() == [] and [r.lang_pred for r in identify(make([(1, "abc")])).collect()] == ["und"]


def brute_languages(rows, buckets, smoothing, evidence):
    """Naive Bayes in plain Python: counts of the hashed 1- to 3-grams one by one."""
    mask = 0xFFFFFFFF

    def grams(text):
        codes = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32]
        for n in (1, 2, 3):
            for e in range(len(codes)):
                last = codes[max(0, e - 1) : e + 1] if n > 1 else [codes[e]]
                if all(c == 32 for c in last):
                    continue
                part = codes[e] * 0x9E3779B1 & mask
                for k in range(2, n + 1):
                    back = codes[e - k + 1] if e - k + 1 >= 0 else 32
                    part = ((part ^ part >> 15) * 0x85EBCA77 + back * 0xC2B2AE3D) & mask
                yield ((part ^ part >> 13) * ((0x27D4EB2F + 2 * n) & mask) & mask) >> 16 if buckets == 1 << 16 else None

    counts, docs = {}, {}
    for i, t, g, *_ in dict.fromkeys(rows):
        if g is not None and t is not None and not (i is not None and zlib.crc32(str(i).encode()) % 5 == 0):
            counts.setdefault(g, Counter()).update(grams(t))
    for i, t, g, *_ in rows:
        if g is not None and t is not None and not (i is not None and zlib.crc32(str(i).encode()) % 5 == 0):
            docs[g] = docs.get(g, 0) + 1
    out = []
    for i, t, *_ in rows:
        if not any(c.isalpha() for c in (t or "").lower()):
            out.append((i, "und", 0.0))
            continue
        seen = list(grams(t))
        fit = {}
        for g in sorted(counts):
            total = sum(counts[g].values()) + smoothing * buckets
            like = sum(math.log((counts[g][b] + smoothing) / total) for b in seen) + math.log(docs[g] / sum(docs.values()))
            fit[g] = like / max(1.0, len(seen) / evidence)
        best = max(sorted(fit), key=fit.get)
        out.append((i, best, 1 / sum(math.exp(v - fit[best]) for v in fit.values())))
    return out


def test_scores_equal_plain_naive_bayes(make):
    rnd = random.Random(6)
    parts = {"en": "the of and ing tion with that", "de": "der die und ung schaft süß das", "fr": "le la les des tion avec éa"}
    rows = []
    for i in range(60):
        g = rnd.choice([*parts, None])
        words = [rnd.choice(rnd.choice(list(parts.values())).split() if g is None or rnd.random() < 0.3 else parts[g].split()) for _ in range(rnd.randint(0, 25))]
        rows.append((i, rnd.choice([" ".join(words), " ".join(words).upper() + "! 12", None, "3 .."] + [" ".join(words)] * 4), g, "s"))
    rows += [rows[7]] * 3 + [(None, "der und", "de", "s")]
    p = LanguageIdParams()
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in identify(make(rows), p).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(brute_languages(rows, p.buckets, p.smoothing, p.evidence), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) < 1e-4 for a, b in zip(got, want))


def test_few_labels_of_many_are_learned(make):
    rows = [(i, f"abc def {i % 3}", "ab"[i % 3 == 0], "s") for i in range(60)] + [(100 + i, "abc", f"x{i}", "s") for i in range(20)]
    assert {r.lang_pred for r in identify(make(rows), LanguageIdParams(languages=2)).collect()} <= {"a", "b"}


def test_labels_of_the_held_out_fold_teach_nothing(make):
    rows = [(i, f"abc{i} def", "en" if zlib.crc32(str(i).encode()) % 5 else "xx", "s") for i in range(60)]
    assert {r.lang_pred for r in identify(make(rows), LanguageIdParams(sample_per_language=10)).collect()} == {"en"}


# --- op 5


def base_spans(t):
    out = [(m.start(), m.end(), 0, "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1, "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p.lstrip("0")[:5] or 0) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2, "card"))
    out += [(m.start(), m.end(), 3, "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


PII_TEXTS = [
    None, "", "a.b@c.org, x@y and q@@r.s t@u.v.w@x.y", "@a.b c@d..e", "ip 1.2.3.4.5.6.7.8 999.1.1.1 0010.1.1.1 1.2.3", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (017) 555-7713 +12 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "É😀 mail é@x.de 😀 a@b.c", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "call 212-555-0199 or (212) 555-0199",
    "Dr. Maria Smith wrote", "1.1.1.1@2.2.2.2 5500 0000 0000 0004", "9" * 5000 + " " + "a" * 5000 + "@" + "b.c",
    "0" * 5000 + ".1.1.1 and 1.1." + "0" * 6000 + "12.3 and 1.1.1." + "9" * 5000,
]


def test_pii_base_spans(make):
    rows = list(enumerate(PII_TEXTS)) + [(2, PII_TEXTS[2])]
    got = find(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = base_spans(PII_TEXTS[r.doc_id] or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, b, _, k in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), PII_TEXTS[r.doc_id][:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
    assert find(make([])).collect() == []


def test_pii_classifier_and_redaction(make):
    rows = [(i, f"my token = 'abcdef0123456789abcdef{i:010d}' for {i}@x.org") for i in range(40)] + [(99, "plain = words_without_digits_at_all"), (100, None)]
    docs = make(rows)
    new = {r.doc_id: r for r in redact(docs).collect()}
    assert redact(docs).columns == docs.columns
    assert new[3].text == "my token = '[SECRET]' for [EMAIL]" and new[3].n_chars == len(new[3].text)
    assert new[99].text == rows[40][1] and new[100].text is None
    model = train({"phone 1 1 1 1 2 2 0 1": 50, "phone -1 0 0 -1 2 2 0 1": 50, "secret 1 0 1 1 4 1 0 0": 20}, PiiParams())
    assert model.probability("phone 1 1 1 1 2 2 0 1") > 0.9 > 0.1 > model.probability("phone -1 0 0 -1 2 2 0 1")
    assert train({}).probability("name 1 0 0 1 1 0 1 2") == 0.5
    rare = train({"phone 1 1 1 1 2 2 0 1": 5, "phone -1 0 0 -1 2 2 0 1": 500, "ssn 1 0 0 1 1 1 0 1": 100}, PiiParams())
    assert rare.share["phone"] < 0.25 < 0.5 < rare.share["ssn"]


def test_pii_finds_what_was_planted(make):
    """Added spans: at least nine of ten planted ones, and none in texts that only look alike."""
    rnd = random.Random(7)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    plant = {
        "secret": lambda: f'api_key = "{hexa(40)}"', "ssn": lambda: f"my ssn is {rnd.randrange(100, 600)}-{rnd.randrange(10, 99)}-{digits(4)}",
        "phone": lambda: f"call me: ({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{digits(4)}", "name": lambda: f"Dear Dr. {rnd.choice(['Maria', 'Peter', 'Anna'])} Weber,",
    }
    clean = (
        lambda: f"version 1.{digits(3)}.{digits(4)}.{digits(2)}", lambda: f"checksum = some_long_identifier_without_digits", lambda: f"see section {digits(3)}, figure {digits(2)}",
        lambda: "a plain text about nothing", lambda: f"isbn {digits(13)}",
    )
    rows, kinds = [], {}
    for i in range(400):
        k = rnd.choice(list(plant)) if i % 2 else None
        rows.append((i, "some words before " + (plant[k] if k else rnd.choice(clean))() + " and some after"))
        kinds[i] = k
    got = {r.doc_id: r for r in find(make(rows)).collect()}
    hit = [kinds[i] in {x.split(":")[0] for x in got[i].spans.split(",")} for i in kinds if kinds[i]]
    assert sum(hit) >= 0.9 * len(hit)
    assert all(not got[i].spans or got[i].n_card + got[i].n_ip for i in kinds if not kinds[i])
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got.values())


# --- op 9


def test_quality_rules(make):
    texts = [None, "", "a b c a b c a b c", "x\ny\nx\n \n \nx", "# * $ word | <>", LONG, "é ü 😀 z\tq", " ".join(map(str, range(60))), "dup line here\n" * 5 + "end"]
    rows = [(i, t, "en", "h" if i % 2 else None) for i, t in enumerate(texts)] + [(100 + i, f"bad {i} ***", "en", "bad") for i in range(20)] + [(7, texts[7], "en", "bad")]
    got = quality_report(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {g for g, n in Counter(grams).items() if n > 1}
        covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept) and (r.kept or r.n_failures > 0)
    assert all(r.host_failed for r in got if r.doc_id >= 100) and all(r.kept for r in got if r.doc_id == 7)
    assert quality_report(make([]), rules=QualityRules()).collect() == []


# --- op 8


def test_lm_base_scores_and_normalisation(make, alike):
    texts = {i: " ".join(f"w{(i * k) % 11}" for k in range(1, 4 + i % 9)) for i in range(60)} | {60: None, 61: "", 62: "The THE\tthe", 63: LONG, 64: alike[0], 65: alike[1], 66: " ".join(alike)}
    got = {r.doc_id: r for r in score_documents(make(list(texts.items())), params=LmParams(block=200, bytes_per_owner=2000)).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for i, t in texts.items()}
    c = Counter(x for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score_documents(make([])).collect() == []
    assert [r.n_known for r in score_documents(make([(None, "a b"), (None, "a b")])).collect()] == [3, 3]


def test_lm_scores_equal_brute_force_and_sum_to_one(make):
    """The model in plain Python: counts, deleted counts, the same steps of expectation-maximisation."""
    rnd = random.Random(3)
    texts = {i: " ".join(rnd.choice("abcdefgh") + rnd.choice("xy") for _ in range(rnd.randrange(0, 25))) for i in range(90)}
    texts |= {200: None, 201: "zz zz new", 202: "ax bx"}
    p = LmParams(block=150, bytes_per_owner=300, buckets=6, em_steps=15)
    got = {r.doc_id: r for r in score_documents(make([*texts.items(), (5, texts[5])]), params=p).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    tokens = {i: [*lower(t).split(), None] for i, t in texts.items()}
    pairs = {i: list(zip([None, *w[:-1]], w)) for i, w in tokens.items()}
    train = [i for i in [*texts, 5] if fold[i] != 1]
    c1, c2 = Counter(x for i in train for x in tokens[i]), Counter(x for i in train for x in pairs[i])
    n, v = sum(c1.values()), len(c1)
    bucket = lambda c: min(int(c).bit_length(), p.buckets - 1)
    step = lambda r: round(math.log2(r) * 4) if r > 0 else -999
    seen = Counter()
    for i in [*texts, 5]:
        if fold[i] == 2:
            own1, own2 = Counter(tokens[i]), Counter(pairs[i])
            for a, b in pairs[i]:
                context = c1[a] - own1[a]
                r2 = (c2[a, b] - own2[a, b]) / context * (v + 1) if context else 0
                seen[bucket(context), step(r2), step((c1[b] - own1[b]) / max(1, n - len(tokens[i])) * (v + 1))] += 1
    w = [[1 / 3] * 3 for _ in range(p.buckets)]
    for _ in range(p.em_steps):
        sums = [[1e-3] * 3 for _ in w]
        for (k, q2, q1), m in seen.items():
            part = [x * (0 if q == -999 else 2 ** (q / 4)) for x, q in zip(w[k], (q2, q1, 0))]
            for j in range(3):
                sums[k][j] += m * part[j] / sum(part)
        w = [[x / sum(s) for x in s] for s in sums]
    w[0] = [0, w[0][1] / (w[0][1] + w[0][2]), w[0][2] / (w[0][1] + w[0][2])]
    chance = lambda a, b: w[bucket(c1[a])][0] * (c2[a, b] / c1[a] if c1[a] else 0) + w[bucket(c1[a])][1] * c1[b] / n + w[bucket(c1[a])][2] / (v + 1)
    for i in texts:
        assert abs(got[i].score - sum(math.log10(chance(a, b)) for a, b in pairs[i])) < 1e-6 * max(1, len(pairs[i]))
    # Over the known words and one for all others, where every context has a successor: each ends or goes on.
    for a in [*c1, "never seen"]:
        assert abs(sum(chance(a, b) for b in c1) + chance(a, "another one never seen") - 1) < 1e-9


def test_lm_lists_of_keys():
    import numpy as np

    from quernel.llm.lm_score import pack_keys, unpack_keys

    rng = np.random.default_rng(1)
    for keys in ([], [0], [2**64 - 1], [1, 2, 3], [5, 2**40, 2**63], sorted({int(x) for x in rng.integers(0, 2**64, 5000, dtype=np.uint64)})):
        assert unpack_keys(pack_keys(np.array(keys, np.uint64))).tolist() == keys


def test_lm_weights_are_probabilities():
    import numpy as np

    p = LmParams(buckets=4)
    w = learn_weights(np.array([(2 * 4096 + 1030) * 4096 + 1010, (1 * 4096 + 1) * 4096 + 1020]), np.array([50, 20]), p)
    assert np.allclose(w.sum(axis=1), 1) and w[2, 0] > 0.9 and w[0, 0] == 0


def test_counts_leave_other_columns_alone(spark):
    rows = [("a b c a b c", 1, 2, 3, 4), (None, 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "text string, _t int, _w int, row int, n_words int")
    got = document_counts(docs).collect()
    assert [(r["text"], r["_t"], r["_w"], r["row"], r["n_words"], r["n_repeat_words"]) for r in got] == [("a b c a b c", 1, 2, 3, 6, 6), (None, 5, 6, 7, 0, 0)]
