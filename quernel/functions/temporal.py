"""Bounds in time that a prompt names in words: ``what did we decide last week``, ``since March``, ``in June 2025``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of months and their numbers.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}
MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
PHRASES = ("today", "yesterday", "this week", "last week", "this month", "last month", "this year", "last year")
PHRASE = "|".join(p.replace(" ", r"\s+") for p in sorted(PHRASES, key=len, reverse=True))


def _span(phrase: Column, today: Column) -> Column:
    """(after, before) of a relative phrase; weeks begin on Monday."""
    week, month, year = (F.trunc(today, unit) for unit in ("week", "month", "year"))
    days = lambda d, n: F.date_add(d, n)
    spans = {
        "today": (today, days(today, 1)), "yesterday": (days(today, -1), today), "this week": (week, days(week, 7)), "last week": (days(week, -7), week),
        "this month": (month, F.add_months(month, 1)), "last month": (F.add_months(month, -1), month),
        "this year": (year, F.add_months(year, 12)), "last year": (F.add_months(year, -12), year),
    }
    out = F.lit(None).cast("struct<after:date,before:date>")
    for name, (after, before) in spans.items():
        out = F.when(phrase == name, F.struct(after.alias("after"), before.alias("before"))).otherwise(out)
    return out


#: (what is counted, pattern of the token and perhaps a year), in the order in which they are tried.
RULES = (
    ("since date", r"\bsince\s+(\d{4}-\d{2}-\d{2})\b()"), ("since phrase", rf"\bsince\s+({PHRASE})\b()"),
    ("since month", rf"\bsince\s+({MONTH})\b(?:\s+(\d{{4}}))?"), ("since year", r"\bsince\s+(\d{4})\b()"), ("phrase", rf"\b({PHRASE})\b()"),
    ("days", r"\bpast\s+(\d{1,3})\s+days?\b()"), ("weeks", r"\bpast\s+(\d{1,3})\s+weeks?\b()"), ("months", r"\bpast\s+(\d{1,3})\s+months?\b()"),
    ("month", rf"\bin\s+({MONTH})\b(?:\s+(\d{{4}}))?"), ("year", r"\bin\s+(\d{4})\b()"),
)


def _step(df: DataFrame, name: str, *columns: Column) -> DataFrame:
    """``df`` with a struct of columns, each worked out once: what is generated is not put into what reads it."""
    return df.withColumn(name, F.explode(F.array(F.struct(*columns))))


def prompt_bounds(prompts: DataFrame, text: str, now: date, name: str = "bound") -> DataFrame:
    """``prompts`` with a struct (after, before) of dates: ``after`` included, ``before`` not and null if open; null
    both if the prompt names no bound, or one that begins after ``now``.

    A trigger word (since, past, in) has to stand right before the date. What comes first in the order of the rules
    decides, and if that is no date there is no bound. A bare month is the last one that has begun.
    """
    today = F.lit(now)
    low = _step(prompts, "_t", F.lower(text).alias("t"))
    said = _step(low, "_m", *(F.regexp_extract("_t.t", p, 1).alias(f"m{i}") for i, (_, p) in enumerate(RULES)))
    rule = F.coalesce(*(F.when(F.col(f"_m.m{i}") != "", i) for i in range(len(RULES))))
    chosen = _step(said, "_c", rule.alias("rule"), F.get(F.array(*(f"_m.m{i}" for i in range(len(RULES)))), rule).alias("token"))
    kinds = {kind: i for i, (kind, _) in enumerate(RULES)}
    of = lambda *names: F.col("_c.rule").isin(*(kinds[n] for n in names))
    token = F.col("_c.token")
    year = F.nullif(F.coalesce(*(F.when(F.col("_c.rule") == kinds[n], F.regexp_extract("_t.t", dict(RULES)[n], 2)) for n in ("since month", "month"))), F.lit(""))
    month = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))[token]
    count = F.when(of("days", "weeks", "months"), token).try_cast("int")
    read = _step(chosen, "_r", year.try_cast("int").alias("year"), F.when(of("since month", "month"), month).alias("month"), count.alias("n"),
                 F.when(of("since year", "year"), token).try_cast("int").alias("only"), F.regexp_replace(token, r"\s+", " ").alias("phrase"))
    first = F.coalesce(F.col("_r.year"), F.lit(now.year) - F.when(F.col("_r.month") > now.month, 1).otherwise(0))
    whole = F.coalesce(F.col("_r.only"), F.when(F.col("_r.month").isNotNull(), first))
    day = F.when(whole.between(1, 9999), F.make_date(whole, F.coalesce("_r.month", F.lit(1)), F.lit(1)))
    spans = _step(read, "_s", _span(F.when(of("phrase", "since phrase"), F.col("_r.phrase")), today).alias("span"), day.alias("day"))
    n, month_start = F.col("_r.n"), F.trunc(today, "month")
    after = (
        F.when(of("since date"), F.try_to_date(token, "yyyy-MM-dd")).when(of("phrase", "since phrase"), F.col("_s.span.after")).when(of("days"), F.date_add(today, -n))
        .when(of("weeks"), F.date_add(today, -7 * n)).when(of("months"), F.add_months(month_start, -n)).otherwise(F.col("_s.day"))
    )
    before = F.when(of("phrase"), F.col("_s.span.before")).when(of("month"), F.add_months("_s.day", 1)).when(of("year"), F.add_months("_s.day", 12))
    found = _step(spans, "_b", after.alias("after"), before.alias("before"))
    fits = F.col("_b.after") <= today
    return found.select(*prompts.columns, F.struct(F.when(fits, F.col("_b.after")).alias("after"), F.when(fits, F.col("_b.before")).alias("before")).alias(name))
