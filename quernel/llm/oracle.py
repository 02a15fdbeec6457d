"""DuckDB statements of the operators that SQL can express, with the limits of their parameters."""

from __future__ import annotations

from quernel.llm.quality_rules import QualityRules

_R = QualityRules()

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT r, doc_id, source,
           list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
    FROM d),
win AS (
    SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
n AS (
    SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, n_symbols,
           len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
           coalesce(rep.n, 0) AS n_repeat_words
    FROM w LEFT JOIN rep USING (r)),
b AS (
    SELECT *, n_words < {_R.min_words} OR n_repeat_words * 100 > n_words * {_R.max_repeat_percent} AS base_failed
    FROM n),
f AS (
    SELECT *, CAST(base_failed AS INT)
           + CAST(n_symbols * 100 > n_words * {_R.max_symbol_percent} AS INT)
           + CAST(n_dup_lines * 100 > n_lines * {_R.max_duplicate_line_percent} AS INT)
           + CAST(word_chars > n_words * {_R.max_mean_word_chars} AS INT) AS n_failures
    FROM b),
h AS (SELECT source, count(*) AS n_docs, count(*) FILTER (n_failures > 0) AS n_failed FROM f GROUP BY source),
m AS (SELECT avg(n_failed / n_docs) AS mean, var_pop(n_failed / n_docs) AS var FROM h),
p AS (SELECT mean, CASE WHEN var > 0 AND var < mean * (1 - mean) THEN mean * (1 - mean) / var - 1 ELSE 1.0 END AS weight FROM m),
v AS (SELECT source, (n_failed + mean * weight) / (n_docs + weight) > {_R.host_rate} AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (host_failed AND n_failures > 0)) AS kept, n_failures, host_failed
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

DIVERGENCE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents),
w AS (SELECT r, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
f AS (
    SELECT lang, source, term, coalesce(c.n, 0) AS n,
           1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.n + v.v) AS p,
           1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (v.n + v.v) AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM f WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM y WHERE part = 'pair' OR rank <= 200
"""


def _repair_sql() -> str:
    """The cheapest edits from each row on, by the role before it (none, s, u, a), as (cost, edits, lines), from the
    last row to the first; of equal costs the least string of edits."""
    put = {"u": "'user:' || chr(10)", "a": "'assistant:' || chr(10)"}

    def step(before: int, role: str, at: int, inserted: str) -> str:
        lines = " || ".join([*(put[i] for i in inserted), "{line}", f"s{at}.o"])
        edits = f"'{'I' * len(inserted)}' || '{{edit}}' || s{at}.e"
        kept = f"CASE WHEN may AND first = '{role}' THEN {{{{'c': {3 * len(inserted)} + extra + s{at}.c, 'e': {edits.format(edit='K')}, 'o': {lines.format(line='kept')}}}}} END"
        if role == "s":
            return kept.replace("{{", "{").replace("}}", "}")
        name = "user" if role == "u" else "assistant"
        changed = f"CASE WHEN may THEN {{{{'c': {3 * len(inserted) + 3} + extra + s{at}.c, 'e': {edits.format(edit='R')}, 'o': {lines.format(line=f"'{name}:' || text || chr(10)")}}}}} END"
        return (kept + ", " + changed).replace("{{", "{").replace("}}", "}")

    ways = {0: [("s", 1, ""), ("u", 2, ""), ("a", 3, "u")], 1: [("u", 2, ""), ("a", 3, "u")],
            2: [("u", 2, "a"), ("a", 3, "")], 3: [("u", 2, ""), ("a", 3, "u")]}
    states = []
    for before, options in ways.items():
        drop = f"{{'c': 4 + s{before}.c, 'e': 'D' || s{before}.e, 'o': s{before}.o}}"
        states.append(f"list_min([{drop}, {', '.join(step(before, *o) for o in options)}]) AS s{before}")
    both = "'user:' || chr(10) || 'assistant:' || chr(10)"
    return rf"""
WITH RECURSIVE tab AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i)),
raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
    FROM conversations),
crc AS (
    SELECT raw.*, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT)),
                                  lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS k
    FROM raw, tab),
rows_ AS (
    SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
           CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM crc),
placed AS (
    SELECT conv_id, turn, role, text, left(role, 1) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j
    FROM rows_),
faults AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 AS again,
           regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS mark,
           lag(first) OVER (PARTITION BY conv_id ORDER BY j) || first AS pair
    FROM placed),
f AS (
    SELECT *, mark <> '' AND NOT again AS may, CASE WHEN mark IN ('.', '!', '?') THEN 0 ELSE 3 END AS extra,
           role || ':' || text || chr(10) AS kept
    FROM faults),
n AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (mark = '') AS blank, count(*) FILTER (mark <> '' AND again) AS duplicate,
           count(*) FILTER (may AND extra > 0) AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id),
best AS (
    SELECT conv_id, n AS j, {{'c': 0, 'e': '', 'o': ''}} AS s0, {{'c': 6, 'e': 'II', 'o': {both}}} AS s1,
           {{'c': 3, 'e': 'I', 'o': {put["a"]}}} AS s2, {{'c': 0, 'e': '', 'o': ''}} AS s3
    FROM n
    UNION ALL
    SELECT best.conv_id, best.j - 1, {", ".join(states)}
    FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.j = best.j)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost,
       coalesce(s0.e, '') AS audit, sha256(coalesce(left(s0.o, greatest(length(s0.o) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
     LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
     LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id AND best.j = 0
"""


REPAIR_SQL = _repair_sql()
