"""Queries of prompts: bounds in time, and chunks, aliases and sentences of notes as search uses them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quernel.functions import temporal
from quernel.plans.book import Book
from quernel.sources.tables import table

BOOK = Book()
q = BOOK.query

#: Prompts end in one of these, by turn.
_ASKED = (
    "last week", "since last   week", "since March", "in June 2025", "in june", "in 2026", "yesterday", "since 2024-02-30", "since 2025-01-31 or today", "past 3 months", "past 10 days", "past 2 weeks",
    "since 2019", "in 2031", "this year", "interested in sept", "the June release", "since December", "last  month", "when did I last go", "in May 2024 or in June", "this month", "since jan 2023", "past 1 week", "today",
)
_NOW = date(2025, 7, 16)
_PICK = "CASE (conv_id * 3 + turn * 7) % {n} {w} END".format(n=len(_ASKED), w=" ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_ASKED)))
_MONTH_SQL = "CASE m " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in temporal.MONTHS.items()) + " END"


def _rule(k: int, pattern: str, after: str, before: str) -> str:
    return f"SELECT conv_id, turn, {k} AS k, {after} AS a, {before} AS b FROM (SELECT *, regexp_extract(t, '{pattern}', 1) AS m, regexp_extract(t, '{pattern}', 2) AS y FROM p) WHERE m <> ''"


def _bound_sql() -> str:
    today = f"DATE '{_NOW}'"
    first = f"make_date(CAST(CASE WHEN y <> '' THEN CAST(y AS INT) WHEN {_MONTH_SQL} > {_NOW.month} THEN {_NOW.year - 1} ELSE {_NOW.year} END AS BIGINT), {_MONTH_SQL}, 1)"
    spans = {
        "today": (today, f"{today} + 1"), "yesterday": (f"{today} - 1", today), "this week": ("DATE '2025-07-14'", "DATE '2025-07-21'"), "last week": ("DATE '2025-07-07'", "DATE '2025-07-14'"),
        "this month": ("DATE '2025-07-01'", "DATE '2025-08-01'"), "last month": ("DATE '2025-06-01'", "DATE '2025-07-01'"), "this year": ("DATE '2025-01-01'", "DATE '2026-01-01'"), "last year": ("DATE '2024-01-01'", "DATE '2025-01-01'"),
    }
    side = lambda i: "CASE regexp_replace(m, '\\s+', ' ', 'g') " + " ".join(f"WHEN '{n}' THEN {s[i]}" for n, s in spans.items()) + " END"
    month, phrase, year = f"({temporal.MONTH})\\b(?:\\s+(\\d{{4}}))?", f"({temporal.PHRASE})\\b()", "make_date(CAST(m AS BIGINT), 1, 1)"
    rules = [
        (r"\bsince\s+(\d{4}-\d{2}-\d{2})\b()", "TRY_CAST(m AS DATE)", "NULL"), (rf"\bsince\s+{phrase}", side(0), "NULL"), (rf"\bsince\s+{month}", first, "NULL"), (r"\bsince\s+(\d{4})\b()", year, "NULL"),
        (rf"\b{phrase}", side(0), side(1)), (r"\bpast\s+(\d{1,3})\s+days?\b()", f"{today} - CAST(m AS INT)", "NULL"), (r"\bpast\s+(\d{1,3})\s+weeks?\b()", f"{today} - 7 * CAST(m AS INT)", "NULL"),
        (r"\bpast\s+(\d{1,3})\s+months?\b()", "CAST(DATE '2025-07-01' - to_months(CAST(m AS INT)) AS DATE)", "NULL"), (rf"\bin\s+{month}", first, f"CAST({first} + INTERVAL 1 MONTH AS DATE)"),
        (r"\bin\s+(\d{4})\b()", year, f"CAST({year} + INTERVAL 12 MONTH AS DATE)"),
    ]
    return f"""WITH p AS (SELECT conv_id, turn, lower(left(text, 30) || ' ' || {_PICK}) AS t FROM conversations), r AS ({" UNION ALL ".join(_rule(k, *x) for k, x in enumerate(rules))}),
 f AS (SELECT conv_id, turn, a, b, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS n FROM r)
 SELECT conv_id, turn, strftime(CASE WHEN a <= {today} THEN a END, '%Y-%m-%d') AS after, strftime(CASE WHEN a <= {today} THEN b END, '%Y-%m-%d') AS before FROM p LEFT JOIN (SELECT * FROM f WHERE n = 1) USING (conv_id, turn)"""


@q(_bound_sql())
def prompt_bounds(spark, d):
    prompt = F.concat(F.left("text", F.lit(30)), F.lit(" "), F.expr(_PICK))
    b = temporal.prompt_bounds(table(spark, d, "conversations").select("conv_id", "turn", prompt.alias("prompt")), "prompt", _NOW)
    return b.select("conv_id", "turn", F.date_format("bound.after", "yyyy-MM-dd").alias("after"), F.date_format("bound.before", "yyyy-MM-dd").alias("before"))
