"""What a note's path, front matter and wording say about it: classes, shapes, cues, bounds, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators.steps import once

#: Openings of mined fragments, and folders whose file names may be cut short.
FRAGMENT_OPENINGS = ("User stated:", "Fix observed:", "User corrected the agent:")
ELLIPSES = ("...", "…")
FRAGMENT_FOLDERS = ("personal/idea", "personal/fix")
#: States of a note that lower its rank, and those that show someone has looked at it.
PENALISED = ("unfiled", "inbox", "superseded", "expired")
PROMOTED = ("active", "filed", "final", "promoted", "done", "ratified", "rendered")
#: What names the type of a link in the words around it, in this order.
EDGE_CUES = (
    ("supersedes", r"(?i)\bsupersede[sd]?\b"),
    ("contradicts", r"(?i)\bmutually exclusive\b|\bcontradicts?\b|\btension\b"),
    ("caused", r"(?i)\b(?:the\s+)?\d+m?-?token incident\b|\bincident autopsy\b|\breproduc\w* (?:the|an?) (?:incident|bug)\b"),
    ("fixed", r"(?i)\bfix(?:ed|es)?\b|\bresolved by\b"),
    ("decided-in", r"(?i)\bdecided\b|\bresolves? tension\b|\bcalibrat\w*\b|\btension #\d+.{0,20}resolution\b"),
    ("implements", r"(?i)\bimplements?\b|\bconforms? to\b|\binherits?\b|\bdesign-doc shape\b"),
    (
        "depends-on",
        r"(?i)\bdepends? on\b|\bfloor it (?:builds|preserves|composes)\b|\bgated on\b|\bcan'?t ship before\b|\bblocked on\b|\bhard precede\b|\bassumes\b"
        r"|\bprereq(?:uisite)?s?\b|\bsoft dependency\b|\bmust already be in place\b|\bgoverning safety constraint\b|\bthe engine it wraps\b",
    ),
    ("uses", r"(?i)\buses\b|\bpairs with\b|\bwrite-authz boundary\b"),
)
#: Words of a rule that asks, and of one that forbids.
ASKS = r"(?i)\b(always|must|required?|require[sd]?)\b"
FORBIDS = r"(?i)\b(never|don'?t|do not|forbidden|forbids?)\b"


def _opens(body: Column, openings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for o in openings:
        out = out | body.startswith(o)
    return out


def in_spaces(path: Column, spaces: tuple[str, ...]) -> Column:
    """Whether the first folder of a path is one of these."""
    return F.split(path, "/")[0].isin(*spaces)


def fragment_signals(path: Column, raw: Column) -> dict[str, Column]:
    """lead_in, mining_confidence and truncated_slug: the shapes of a mined fragment."""
    front, body = X.head(raw), F.ltrim(F.regexp_replace(X.body(raw), r"^[ \t\r\n]+", ""))
    folder, name = X.split_path(path)
    short = X.truncated_slug(F.regexp_replace(name, r"\.md$", "")) | _opens(body, ELLIPSES)
    return {
        "lead_in": _opens(body, FRAGMENT_OPENINGS),
        "mining_confidence": front.rlike(r"(?m)^mining_confidence:"),
        "truncated_slug": folder.isin(*FRAGMENT_FOLDERS) & short,
    }


def durable(path: Column, raw: Column, exempt: tuple[str, ...] = ()) -> Column:
    """A note that age does not touch: by tier, by kind, in a folder of decisions, or in an exempt space."""
    front = X.head(raw)
    tier = F.coalesce(F.lower(X.field(front, "lifecycle_tier")) == "durable", F.lit(False))
    kind = F.coalesce(F.lower(X.field(front, "kind")) == "failure-incident", F.lit(False))
    decided = F.exists(F.split(path, "/"), lambda s: F.lower(s) == "decisions")
    return tier | kind | decided | (in_spaces(path, exempt) if exempt else F.lit(False))


def note_classes(path: Column, raw: Column, spaces: tuple[str, ...] = ("_inbox", "_archive"), exempt: tuple[str, ...] = ()) -> Column:
    """The classes of a note in their order: space, durable, artifact, fragment or fragment-promoted, status, staging."""
    front, body = X.head(raw), X.body(raw)
    state = F.coalesce(X.status(front), F.lit(""))
    shaped = F.lit(False)
    for c in fragment_signals(path, raw).values():
        shaped = shaped | c
    staged = path.startswith("_dream-staging/") & (path.endswith(".proposal.md") | body.rlike(r"\A#[ \t]*Proposal[ \t]+\d+[ \t]*:"))
    return F.array_compact(
        F.array(
            F.when(in_spaces(path, spaces), "space"),
            F.when(durable(path, raw, exempt), "durable"),
            F.when(F.lower(X.field(front, "altitude")) == "artifact", "artifact"),
            F.when(shaped, F.when(state.isin(*PROMOTED), "fragment-promoted").otherwise("fragment")),
            F.when(state.isin(*PENALISED), "status"),
            F.when(staged, "staging"),
        )
    )


def edge_type(window: Column) -> Column:
    """The first cue that the words around a link hold, else references."""
    return F.coalesce(*(F.when(window.rlike(X.ascii_borders(p)), F.lit(name)) for name, p in EDGE_CUES), F.lit("references"))


def typed_edges(notes: DataFrame, raw: str, key: str, before: int = 160, after: int = 90) -> DataFrame:
    """(key, target, edge_type, place): wiki links outside fences and code spans, typed by the words around, and
    those that the front matter names as superseded or superseding (place 0)."""
    # Links in fences and code spans lose their brackets, so places of all else stay.
    t = F.regexp_replace(F.col(raw), r"(?s)```.*?```|`[^`\n]*`", "")
    n = notes.select(key, raw)
    parts = F.split("_t", r"\[\[")
    # Where each link begins, in one run over the parts; its words are cut out before links become rows.
    run = F.aggregate(
        F.slice("_p", 1, F.size("_p") - 1), F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("begins")),
        lambda s, x: F.struct((s["at"] + F.length(x) + 2).alias("at"), F.concat(s["begins"], F.array(s["at"] + F.length(x))).alias("begins")),
    )
    n_ = once(once(once(n.select(key, raw), _t=t), _p=parts), _begins=run["begins"])

    def link(part: Column, i: Column) -> Column:
        place = F.get("_begins", i)
        start = F.greatest(F.lit(1), place - before)
        long = F.length(F.regexp_extract(part, r"^[^\]]*\]\]", 0))
        window = F.substring(F.col("_t"), start, place - start + 2 + long + after)
        return F.struct(F.trim(F.regexp_extract(part, r"^([^\]|#]+)[^\]]*\]\]", 1)).alias("target"), window.alias("window"), place.cast("long").alias("place"))

    found = n_.select(key, F.inline(F.transform(F.slice("_p", 2, F.size("_p")), link)))
    inner = found.where("target <> ''").select(key, "target", edge_type(F.col("window")).alias("edge_type"), "place")
    front = X.head(F.col(raw))
    named = F.array(*(F.regexp_replace(X.field(front, k), r"^\[\[|\]\]$", "") for k in ("supersedes", "superseded_by")))
    outer = n.select(key, F.explode(F.array_compact(named)).alias("target"), F.lit("supersedes").alias("edge_type"), F.lit(0).cast("long").alias("place"))
    return inner.unionByName(outer)


def polarity(sentence: Column) -> Column:
    """positive if it asks, negative if it forbids, null if neither or both."""
    asks, forbids = sentence.rlike(X.ascii_borders(ASKS)), sentence.rlike(X.ascii_borders(FORBIDS))
    return F.when(asks & ~forbids, "positive").when(forbids & ~asks, "negative")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def quoted_terms(query: Column) -> Column:
    """A search expression from whatever was typed: each run of letters, digits and underscores in quotes."""
    return F.array_join(F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z0-9_]+"), 0), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")


def bound(value: Column) -> Column:
    """A date or time in one of the readable layouts as a UTC time; null if it is none."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(F.trim(value), F.lit(x)) for x in layouts))


def within(time: Column, after: Column, before: Column) -> Column:
    """From ``after`` on and before ``before``; a bound that is null does not bind."""
    return (after.isNull() | (time >= after)) & (before.isNull() | (time < before))


def acronym(phrase: Column) -> Column:
    """The initials of a phrase's words, in upper case."""
    return F.upper(F.array_join(F.transform(F.filter(F.split(phrase, "[^A-Za-z0-9]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))


def merged_aliases(supplied: Column, derived: Column, cap: int = 24) -> Column:
    """Both lists, what was supplied first, each alias once whatever its case, at most ``cap``."""
    every = F.filter(F.concat(supplied, derived), lambda a: F.trim(a) != "")
    low = F.transform(every, lambda a: F.lower(a))
    return F.slice(F.filter(every, lambda a, i: F.array_position(low, F.lower(a)) == i + 1), 1, cap)


#: What of a text a rewrite must keep besides names: code spans, URLs, dates, dotted and snake names, camel
#: names, and numbers of two digits and more or with a mark inside.
DISTINCTIVE = (
    r"`([^`\n]+)`", r"(https?://[^\s)>\]\"']+)", r"(\b\d{4}-\d{2}-\d{2}\b|\b\d{4}/\d{2}/\d{2}\b)", r"(\b[A-Za-z_][A-Za-z0-9_]*(?:[_.][A-Za-z0-9_]+)+\b)",
    r"(\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b)", r"(\b\d+(?:[.,]\d+)+\b|\b\d{2,}\b)",
)
_EDGE = r"^[.,;:!?()\[\]{}\"'`]+|[.,;:!?()\[\]{}\"'`]+$"


def capitalised_names(text: Column) -> Column:
    """Words in capitals of two letters and more, and within sentences capitalised words of three and more."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, _EDGE, ""))

    def name(w: Column, last: Column) -> Column:
        inside = ~last.rlike(r"[.!?:]$")
        upper = w.rlike(r"\p{Lu}") & ~w.rlike(r"[\p{L}&&[^\p{Lu}]]")
        return F.when((upper & (F.length(w) > 1)) | (inside & w.rlike(r"^\p{Lu}") & (F.length(w) > 2)), w)

    # Beside each word the one before it; the first begins a sentence.
    return F.array_compact(F.zip_with(bare, F.concat(F.array(F.lit(".")), words), name))


def distinctive(text: Column) -> Column:
    """What a rewrite of a text must keep, sorted, each once."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in DISTINCTIVE), capitalised_names(text))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "")))


def dropped_tokens(source: Column, rewrite: Column) -> Column:
    """Distinctive tokens of the source that the rewrite no longer holds."""
    # The rewrite goes along with the fold, so that it is worked out once.
    none = F.struct(rewrite.alias("text"), F.array().cast("array<string>").alias("lost"))
    keep = lambda s, t: F.struct(s["text"].alias("text"), F.when(F.contains(s["text"], t), s["lost"]).otherwise(F.concat(s["lost"], F.array(t))).alias("lost"))
    return F.aggregate(distinctive(source), none, keep)["lost"]


def noise_token(token: Column, stop: tuple[str, ...] = tuple(X.STOPWORDS)) -> Column:
    """Stopwords, names of media files and hexadecimal ids."""
    return F.lower(token).isin(*stop) | token.rlike(r"(?i)\.(png|jpe?g|gif|svg|mp4|pdf)$") | token.rlike("^[0-9a-f]{7,}$")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def node_radius(degree: Column) -> Column:
    return 2.0 + 1.4 * F.sqrt(degree)


def embed_text(title: Column, body: Column, most: int | None = None) -> Column:
    """Title, blank line and body without white space at the ends; ``most`` characters at most."""
    out = F.trim(F.concat_ws("\n\n", F.nullif(F.trim(title), F.lit("")), F.trim(body)))
    return F.substring(out, 1, most) if most else out


def enrichment_key(body: Column, version: str, rules: str) -> Column:
    """The hash under which the enrichment of a body is known."""
    return F.sha2(F.concat(F.lit(f"{version}\n{rules}\n"), X.normalised_body(body)), 256)


def candidate_identity(url: Column, content: Column) -> Column:
    """A feed item's URL, or else the first half of its content's hash."""
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), F.substring(F.sha2(content, 256), 1, 16))


def schema_reason(title: Column, body: Column, kind: Column, kinds: tuple[str, ...], slug: Column, confidence: Column, tags: Column, most_tags: int) -> Column:
    """Why an enriched note does not keep to its contract, or null."""
    return F.coalesce(
        F.when(F.coalesce(F.trim(title), F.lit("")) == "", "title"), F.when(F.coalesce(F.trim(body), F.lit("")) == "", "body"),
        F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "type"), F.when(~F.coalesce(slug.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "slug"),
        F.when(~F.coalesce(confidence.between(0, 1), F.lit(True)), "confidence"), F.when(F.size(tags) > most_tags, "tags"),
    )
