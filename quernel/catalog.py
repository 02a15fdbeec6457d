"""All queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernel.plans import feed_queries, governance_queries, graph_queries, note_queries, prompt_queries, quality_queries, search_queries, state_queries, store_queries, text_queries, transcript_queries, upkeep_queries

BOOKS = (text_queries.BOOK, search_queries.BOOK, graph_queries.BOOK, state_queries.BOOK, quality_queries.BOOK, note_queries.BOOK, transcript_queries.BOOK, feed_queries.BOOK, prompt_queries.BOOK, governance_queries.BOOK, upkeep_queries.BOOK, store_queries.BOOK)
FLAGSHIP = "hybrid_rrf"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for book in BOOKS for name, f in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
