"""A corpus from documents to packed sequences: each stage works on all that the one before kept.

Stages, in order: language identification (documents without a known language go), n-gram Jaccard join
(one document of each group stays), benchmark decontamination (documents that hold an item go), PII
(spans become placeholders) and packing. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm.decontaminate import decontaminate
from quernel.llm.durable import cut, read
from quernel.llm.language_id import keep_identified
from quernel.llm.ngram_join import JoinParams, deduplicate
from quernel.llm.packing import pack_documents
from quernel.llm.pii import redact


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown or uncertain."""
    return keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: five-word Jaccard of 0.8 or more."""
    return deduplicate(docs, JoinParams(n=5, percent=80))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it is or with other numbers, names or units."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds."""
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece of a document."""
    return pack_documents(docs)


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("personal data", redact_personal_data),
    ("packing", pack),
]

#: Token ids, a trained classifier and a tree join are not SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
