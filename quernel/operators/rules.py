"""Rules in notes: sentences that ask or forbid, the work they speak of, and rules that reverse each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators.signals import polarity

#: The words that say which work a rule is about.
ANCHORS = (
    r"\b(test|tests|testing|commit|commits|gate|gates|review|reviews|ship|shipping|release|releases|plan|plans|deploy|deploys|"
    r"pr|prs|merge|merges|verif\w+|lint|build|builds|ci|refactor\w*|debug\w*|document\w*|docs|design|designs|"
    r"branch|branches|rollback|revert|migration|migrations)\b"
)


def sentences(text: Column) -> Column:
    """Sentences without white space around; they end in a mark that white space follows."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def rule_sentences(notes: DataFrame, text: str, key: str) -> DataFrame:
    """(key, place, sentence, polarity, anchors): the sentences that ask or forbid, not both. Null texts have none."""
    s = notes.select(key, F.posexplode(sentences(F.col(text))).alias("place", "sentence"))
    s = s.withColumn("polarity", polarity(F.col("sentence"))).where("polarity IS NOT NULL")
    return s.withColumn("anchors", F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(X.ascii_borders(ANCHORS)), 1)))


def contradicted(entries: DataFrame, bases: DataFrame, text: str, key: str) -> DataFrame:
    """(key, base, place, sentence): for each entry that reverses a sentence of a base note, the first such
    base and in it the first such sentence. Opposite polarity on a shared anchor reverses; a note does not reverse
    itself.

    Of the bases only the two first for each anchor and polarity are needed (one may be the entry), so what entries
    meet has a few rows for each anchor, however many notes speak of it.
    """
    said = rule_sentences(bases, text, key).select(key, "place", "polarity", F.explode("anchors").alias("anchor"))
    own = said.groupBy("anchor", "polarity", F.col(key).alias("base")).agg(F.min("place").alias("place"))
    least = own.groupBy("anchor", "polarity").agg(F.min(F.struct("base", "place")).alias("one"))
    rest = own.join(least, ["anchor", "polarity"]).where(F.col("base") != F.col("one.base"))
    other = rest.groupBy("anchor", "polarity").agg(F.min(F.struct("base", "place")).alias("two"))
    # Under the polarity that meets it.
    facing = least.join(other, ["anchor", "polarity"], "left").withColumn("polarity", F.when(F.col("polarity") == "positive", "negative").otherwise("positive"))
    asked = rule_sentences(entries, text, key).select(key, "polarity", F.explode("anchors").alias("anchor")).distinct()
    met = asked.join(facing, ["anchor", "polarity"])
    # An entry may meet a base on one anchor early and on another late in the base's text: the first base, then the first place.
    first = F.when(F.col("one.base").eqNullSafe(F.col(key)), F.col("two")).otherwise(F.col("one"))
    met = met.withColumn("first", first).where("first IS NOT NULL")
    least_base = met.groupBy(key).agg(F.min("first").alias("first"))
    base = bases.select(F.col(key).alias("base"), text)
    found = least_base.select(key, "first.base", "first.place").join(base, "base")
    sentence = F.get(sentences(F.col(text)), F.col("place"))
    return found.select(key, "base", "place", sentence.alias("sentence"))
