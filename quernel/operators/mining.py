"""Mining of transcripts: phrases by which people state preferences, correct, report fixes and float ideas.

Patterns run over each message where it lies, in Arrow batches, as their places in the text are needed for the
excerpts. A pattern is tried only where one of its stems stands. What is found is grouped by session, category and
slug; the first place decides the wording, the number of places the confidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (pattern, rationale) of each family in order, and how often a tool or a phrase has to occur.
BARE = "explicit always/never directive"
PREFERENCES = (
    (r"\b(?:always|never)\s+\w+(?:\s+\w+){0,5}", BARE),
    (r"\bI\s+(?:prefer|want|need|like|expect|require)\b[^.!?\n]{0,80}", "explicit preference statement"),
    (r"\b(?:use|do|prefer)\s+[\w\s-]{1,40}\s+(?:not|instead of|rather than)\s+\w+", "explicit choice statement"),
    (r"\bdon'?t\s+(?:use|do|add|include|put|write|commit)\b[^.!?\n]{0,80}", "explicit negative directive"),
)
CORRECTIONS = (
    (r"\b(?:no|nope|actually|wait)[\s,.]+[^.!?\n]{0,80}(?:wrong|incorrect|missing|broken|not right)\b", "user correction signal"),
    (r"\b(?:you|that)\s+should(?:n'?t|\s+not)?\s+have\s+\w+", "user retrospective correction"),
    (r"\bI\s+(?:said|told|asked)\s+(?:you\s+)?(?:to\s+)?\w+", "user repeats instruction"),
)
IDEAS = (
    (r"\bwe\s+(?:should|could)\s+(?:also|later|eventually)\b[^.!?\n]{0,120}", "explicit follow-up suggestion"),
    (r"\b(?:later|future)\b[\s,]+[^.!?\n]{0,30}\b(?:could|should|might|may|would)\b[^.!?\n]{0,80}", "future-possibility statement"),
    (r"\bfollow.?ups?\b[^.!?\n]{0,120}", "follow-up marker"),
    (r"\bcould be (?:its|their) own\b[^.!?\n]{0,80}", "potential project split"),
    (r"\bas a follow.?up\b[^.!?\n]{0,120}", "follow-up marker"),
    (r"\bidea[s]?\s*[:—-]\s+\w+[^.!?\n]{0,120}", "idea declaration"),
)
FIXES = (
    (r"\bfixed by\b[^.!?\n]{0,120}", "explicit fix statement"),
    (r"\bresolved by\b[^.!?\n]{0,120}", "explicit resolution statement"),
    (r"\bworkaround\b[^.!?\n]{0,120}", "workaround mention"),
    (r"\b(?:bug|error|issue|failure)\b[^.!?\n]{0,40}\bwas\b[^.!?\n]{0,40}\b(?:caused by|due to|because of)\b[^.!?\n]{0,80}", "root cause statement"),
)
OFTEN, OFTEN_IDEA, RADIUS = 3, 2, 80

#: (family, category, who, patterns) in the order in which a message is read; the stems of a pattern are its longest
#: fixed parts, one of which stands wherever it matches.
FAMILIES = (
    ("preference", "preferences", ("user",), PREFERENCES),
    ("correction", "preferences", ("user",), CORRECTIONS),
    ("idea", "idea", ("user",), IDEAS),
    ("fix", "fix", ("user", "assistant"), FIXES),
)
_STEMS = {
    "preference": (("always", "never"), ("prefer", "want", "need", "like", "expect", "require"), ("not", "instead", "rather"), ("don",)),
    "correction": (("wrong", "incorrect", "missing", "broken", "not right"), ("should",), ("said", "told", "asked")),
    "idea": (("should", "could"), ("later", "future"), ("follow",), ("could be",), ("follow",), ("idea",)),
    "fix": (("fixed by",), ("resolved by",), ("workaround",), ("caused by", "due to", "because of")),
}


def _slug(text: str) -> str:
    return "-".join(re.findall("[a-z0-9]+", text.lower())[:6]) or "candidate"


def _excerpt(text: str, start: int, end: int) -> str:
    low, high = max(0, start - RADIUS), min(len(text), end + RADIUS)
    middle = re.sub(r"\s+", " ", text[low:high].strip())
    return ("..." if low else "") + middle + ("..." if high < len(text) else "")


def _finds(kind: str, text: str, compiled) -> Iterator[tuple]:
    """(place in the message, category, slug, confidence, title, body, rationale, excerpt) of all that matches."""
    folded, place = text.casefold(), 0
    for family, category, who, patterns in compiled:
        if kind not in who:
            continue
        for pattern, rationale, stems in patterns:
            if not any(s in folded for s in stems):
                continue
            for m in pattern.finditer(text):
                shown = _excerpt(text, m.start(), m.end())
                said = m.group(0).strip()
                title, body, named, confidence = {
                    "preference": (said[:80], f"User stated: {shown}", said, "MEDIUM" if rationale == BARE else "HIGH"),
                    "correction": (f"Correction: {said[:60]}", f"User corrected the agent: {shown}", said, "MEDIUM"),
                    "idea": (shown[:80], shown, shown[:60], "MEDIUM"),
                    "fix": (f"Fix: {shown[:60]}", f"Fix observed: {shown}", shown[:60], "MEDIUM"),
                }[family]
                yield place, category, _slug(named), confidence, title, body, rationale, shown
                place += 1


_FOUND = "place int, category string, slug string, confidence string, title string, body string, rationale string, excerpt string"


def pattern_hits(messages: DataFrame, session: str, order: str, kind: str = "kind", text: str = "text") -> DataFrame:
    """(session, order, place, category, slug, confidence, title, body, rationale, excerpt): each place where a
    pattern matches. Messages without text or of another kind have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(f, c, who, [(re.compile(p, re.IGNORECASE), r, s) for (p, r), s in zip(patterns, _STEMS[f])]) for f, c, who, patterns in FAMILIES]
        for batch in batches:
            rows, found = [], []
            for i, (k, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for hit in _finds(k, t, compiled):
                    rows.append(i)
                    found.append(hit)
            if found:
                kept = batch.select([0, 1]).take(pa.array(rows))
                places, *rest = zip(*found)
                columns = [*kept.columns, pa.array(places, pa.int32()), *(pa.array(c, pa.string()) for c in rest)]
                yield pa.RecordBatch.from_arrays(columns, names=[session, order, *(f.split()[0] for f in _FOUND.split(", "))])

    types = [messages.select(c).schema[0].dataType.simpleString() for c in (session, order)]
    rows = messages.where(F.length(text) > 0).select(session, order, kind, text)
    return rows.mapInArrow(find, f"{session} {types[0]}, {order} {types[1]}, {_FOUND}")


def candidates(messages: DataFrame, session: str, order: str, kind: str = "kind", text: str = "text", tools: str = "tools") -> DataFrame:
    """(session, category, slug, confidence, title, body, rationale, occurrences): what a session is mined for.

    The first hit of a slug gives the wording. A medium confidence falls to low under three occurrences, of an idea
    under two. A tool called three times and more is a workflow.
    """
    hits = pattern_hits(messages, session, order, kind, text)
    first = F.min_by(F.struct("confidence", "title", "body", "rationale"), F.struct(order, "place"))
    grouped = hits.groupBy(session, "category", "slug").agg(first.alias("first"), F.count("*").alias("occurrences"))
    often = F.when(F.col("category") == "idea", OFTEN_IDEA).otherwise(OFTEN)
    confidence = F.when((F.col("first.confidence") == "MEDIUM") & (F.col("occurrences") < often), "LOW").otherwise(F.col("first.confidence"))
    mined = grouped.select(session, "category", "slug", confidence.alias("confidence"), "first.title", "first.body", "first.rationale", "occurrences")
    calls = messages.where((F.col(kind) == "assistant") & (F.length(text) > 0)).select(session, F.explode(tools).alias("tool"))
    calls = calls.groupBy(session, "tool").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= OFTEN)
    slug = F.array_join(F.slice(F.regexp_extract_all(F.lower(F.concat(F.lit("workflow "), "tool")), F.lit("[a-z0-9]+"), 0), 1, 6), "-")
    n = F.col("occurrences").cast("string")
    workflows = calls.select(
        session, F.lit("workflow").alias("category"), slug.alias("slug"), F.lit("MEDIUM").alias("confidence"),
        F.concat(F.lit("Workflow: "), "tool", F.lit(" used "), n, F.lit("x")).alias("title"),
        F.concat(F.lit("The `"), "tool", F.lit("` tool was invoked "), n, F.lit(" times during this session. If this represents a repeatable workflow, capture the sequence + when to use it.")).alias("body"),
        F.concat(F.lit(f"tool_use frequency threshold (N>={OFTEN}, observed "), n, F.lit(")")).alias("rationale"), "occurrences")
    return mined.unionByName(workflows)


def unmined(messages: DataFrame, state: DataFrame, session: str) -> DataFrame:
    """Messages of sessions that the state (session, status) does not know as done."""
    return messages.join(state.where("status = 'done'").select(session), session, "left_anti")


def session_states(messages: DataFrame, mined: DataFrame, session: str) -> DataFrame:
    """(session, messages, memories, ideas, status): the state that a run over these messages adds."""
    counts = mined.groupBy(session).agg(F.count_if(F.col("category") != "idea").alias("memories"), F.count_if(F.col("category") == "idea").alias("ideas"))
    seen = messages.groupBy(session).agg(F.count("*").alias("messages"))
    return seen.join(counts, session, "left").fillna(0, ["memories", "ideas"]).withColumn("status", F.lit("done"))
