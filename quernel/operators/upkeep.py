"""Upkeep of a corpus: footers of who links here, work that entities and missing targets ask for, excerpts for judging,
audits of what was done, and checks of how a note is to be split."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.steps import once

#: Marks around what a footer rewrites; all outside them is the writer's.
BEGIN, END = "<!-- backlinks -->", "<!-- /backlinks -->"
#: Mentions that make an entity worth a file, notes that make a missing target worth a stub, mutations that an
#: audit looks at, the rate of disagreement that alarms, and fragments of a split at most.
LEAST_MENTIONS, LEAST_SOURCES, AUDITED, ALARM, MOST_FRAGMENTS = 5, 2, 25, 0.2, 6
#: Characters of an excerpt's head, tail and middle pieces, how many of these, and what stays whole.
HEAD, TAIL, MIDDLE, MIDDLES, WHOLE = 900, 500, 700, 2, 3500


def _block() -> str:
    return f"(?s){re.escape(BEGIN)}.*?{re.escape(END)}"


def strip_footer(body: Column) -> Column:
    """A body without its footer; what the writer wrote stays as it is but for line breaks at the end."""
    bare = F.regexp_replace(body, _block(), "")
    return F.when(bare.rlike(r"\S"), F.concat(F.regexp_replace(bare, r"\n+\z", ""), F.lit("\n"))).otherwise(bare)


def with_footer(body: Column, footer: Column) -> Column:
    """A body with the footer in place of the one it has, else at its end."""
    has = body.rlike(_block())
    first, rest = F.regexp_replace(body, f"(?s){re.escape(BEGIN)}.*\\z", ""), F.regexp_extract(body, f"(?s){re.escape(BEGIN)}.*?{re.escape(END)}(.*)\\z", 1)
    return F.when(has, F.concat(first, footer, rest)).otherwise(F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit("\n\n"), footer, F.lit("\n")))


def backlink_footers(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, body) of the notes (path, body) whose footer is to be written anew, from edges (s, t): sources once, in
    order. A note that nothing links to loses its footer; one that is as it should be is not among them."""
    sources = edges.where("s <> t").select("s", "t").distinct().groupBy(F.col("t").alias("path")).agg(F.array_sort(F.collect_list("s")).alias("_s"))
    lines = F.array_join(F.transform("_s", lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")
    footer = F.concat(F.lit(f"{BEGIN}\n\n**Referenced by:**\n\n"), lines, F.lit(f"\n\n{END}"))
    old = F.coalesce(F.col("body"), F.lit(""))
    gone = F.when(old.rlike(_block()), strip_footer(old)).otherwise(old)
    joined = notes.select("path", "body").join(sources, "path", "left")
    new = once(joined, _new=F.when(F.col("_s").isNull(), gone).otherwise(with_footer(old, footer)))
    return new.where(F.col("_new") != old).select("path", F.col("_new").alias("body"))


def rollup_requests(mentions: DataFrame, least: int = LEAST_MENTIONS) -> DataFrame:
    """(owner, target, reason) for each entity (uri, mentions, file) that many notes mention and no file answers for."""
    asked = mentions.where((F.col("mentions") >= least) & F.col("file").isNull() & (F.coalesce("uri", F.lit("")) != ""))
    reason = F.concat(F.lit("mentioned in "), F.col("mentions").cast("string"), F.lit(" notes with no entity file"))
    return asked.select(F.lit("entity-rollup").alias("owner"), F.col("uri").alias("target"), reason.alias("reason"))


def stub_requests(dangling: DataFrame, least: int = LEAST_SOURCES) -> DataFrame:
    """(owner, target, reason) for each missing target (target, n_sources) that several notes link to."""
    asked = dangling.where((F.col("n_sources") >= least) & (F.coalesce("target", F.lit("")) != ""))
    reason = F.concat(F.col("n_sources").cast("string"), F.lit(" notes link to it and nothing answers"))
    return asked.select(F.lit("stub-synthesis").alias("owner"), "target", reason.alias("reason"))


def document_frequencies(texts: DataFrame, text: str) -> tuple[DataFrame, int]:
    """((term, df), number of texts)."""
    terms = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")), texts.count()


def answer_excerpts(pairs: DataFrame, question: str, text: str, df: DataFrame, n_texts: int, *keys: str) -> DataFrame:
    """(keys, excerpt): of each text its head, the two middle pieces that say most about the question, and its tail; a short
    text is whole. A piece counts each of the question's terms by its rarity, three times at most."""
    asked = pairs.select(*keys, F.explode(F.filter(F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]+"), 0)), lambda t: F.length(t) > 2)).alias("term"))
    weight = F.ln(1 + F.lit(max(1, n_texts)) / (1 + F.coalesce("df", F.lit(0))))
    weights = asked.join(df, "term", "left").groupBy(*keys).agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("_terms"))
    rows = pairs.select(*keys, text).join(weights, list(keys), "left")
    long = F.length(text) > WHOLE
    inner = F.when(long, F.substring(F.col(text), F.lit(HEAD + 1), F.length(text) - HEAD - TAIL))
    starts = F.sequence(F.lit(0), F.greatest(F.length("_inner") - MIDDLE, F.lit(1)) - 1, F.lit(MIDDLE // 2))
    rows = once(once(rows, _inner=inner), _starts=F.when(F.col("_inner").isNotNull(), starts))
    pieces = F.transform("_starts", lambda i: F.struct(i.alias("at"), F.substring(F.col("_inner"), i + 1, F.lit(MIDDLE)).alias("piece")))
    rows = once(rows, _pieces=F.transform(pieces, lambda p: F.struct(p["at"].alias("at"), p["piece"].alias("piece"), F.regexp_extract_all(F.lower(p["piece"]), F.lit("[a-z0-9]+"), 0).alias("words"))))

    def score(words: Column) -> Column:
        held = lambda t: F.least(F.size(F.filter(words, lambda w: w == t["term"])), F.lit(3))
        return F.aggregate(F.coalesce("_terms", F.array().cast("array<struct<term:string,w:double>>")), F.lit(0.0), lambda s, t: s + t["w"] * held(t))

    best = F.slice(F.array_sort(F.transform("_pieces", lambda p: F.struct((-F.round(score(p["words"]), 9)).alias("s"), p["at"].alias("at"), p["piece"].alias("piece")))), 1, MIDDLES)
    cut = F.concat_ws("\n[...]\n", F.left(text, F.lit(HEAD)), F.array_join(F.transform(best, lambda b: b["piece"]), "\n[...]\n"), F.right(text, F.lit(TAIL)))
    return rows.select(*keys, F.when(F.col("_inner").isNotNull(), cut).otherwise(F.col(text)).alias("excerpt"))


def sampled_audits(mutations: DataFrame, cycle: str, order: str, verdict: str, most: int = AUDITED) -> DataFrame:
    """(cycle, sampled, agreed, rate, alarming): of each cycle's mutations the first ``most`` in order, and how many of their
    judgements disagree; what is not "agree" disagrees."""
    first = mutations.withColumn("_k", F.row_number().over(Window.partitionBy(cycle).orderBy(order))).where(F.col("_k") <= most)
    agreed = F.count_if(F.col(verdict).eqNullSafe("agree"))
    rate = 1 - agreed / F.count("*")
    return first.groupBy(cycle).agg(F.count("*").alias("sampled"), agreed.alias("agreed"), rate.alias("rate"), (rate > ALARM).alias("alarming"))


def split_reason(slugs: Column) -> Column:
    """Why a note may not be split into fragments with these slugs, or null: one is no split, too many are a list, and each
    needs a slug of its own, in lower case with hyphens."""
    wrong = F.transform(
        slugs,
        lambda s, i: F.when(F.coalesce(F.trim(s), F.lit("")) == "", F.concat(F.lit("no slug at "), i.cast("string")))
        .when(~s.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.concat(F.lit("bad slug at "), i.cast("string")))
        .when(F.array_position(slugs, s) <= i, F.concat(F.lit("repeated slug at "), i.cast("string"))),
    )
    n = F.coalesce(F.size(slugs), F.lit(0))
    return F.when(n < 2, "no split").when(n > MOST_FRAGMENTS, "a list").otherwise(F.get(F.array_compact(wrong), F.lit(0)))


def stratum_scores(scores: DataFrame) -> DataFrame:
    """(stratum, block, n, right, rate) of scored questions (stratum, is_negative, hit, returned, gate_only, excluded):
    found ones of those that expect something, empty answers of those that expect nothing. Questions that are the gate's
    business, and those whose notes this way of asking leaves out, stand in blocks of their own."""
    block = F.when(F.col("is_negative") & F.col("gate_only"), "gate-only").when(F.col("is_negative"), "rejection").when(F.col("excluded"), "excluded").otherwise("recall")
    right = F.when(F.col("is_negative"), F.col("returned") == 0).otherwise(F.coalesce("hit", F.lit(False)))
    grouped = scores.select("stratum", block.alias("block"), right.alias("right")).groupBy("stratum", "block").agg(F.count("*").alias("n"), F.count_if("right").alias("right"))
    return grouped.withColumn("rate", F.col("right") / F.col("n"))
