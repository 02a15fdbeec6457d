"""Bounds of prompts with odd months, years and texts."""

from datetime import date

from quernel.functions import temporal


def test_bounds_of_odd_prompts(spark):
    asked = {
        "since 2024-13-01 and last week": (None, None), "SINCE last  week": (date(2024, 12, 30), None), "in december": (date(2024, 12, 1), date(2025, 1, 1)),
        "in january": (date(2025, 1, 1), date(2025, 2, 1)), "in may 0000": (None, None), "in 0000": (None, None), "since 9999": (None, None), "past 999 months": (date(1941, 10, 1), None),
        "past 0 days": (date(2025, 1, 8), None), "past 1000 days": (None, None), "last year": (date(2024, 1, 1), date(2025, 1, 1)), "this week": (date(2025, 1, 6), date(2025, 1, 13)),
        "the may release": (None, None), "": (None, None), None: (None, None), "in mayhem": (None, None), "yesterday": (date(2025, 1, 7), date(2025, 1, 8)), "since sept 2024": (date(2024, 9, 1), None),
    }
    df = spark.createDataFrame([(k, 1) for k in asked], "text string, bound int").withColumnRenamed("bound", "other")
    got = {r["text"]: tuple(r["bound"]) for r in temporal.prompt_bounds(df, "text", date(2025, 1, 8)).collect()}
    assert got == asked
