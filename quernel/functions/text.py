"""Column functions over text: tokens, stems, slugs, front matter, links, entities, scrubbing, URLs.

All are built-in expressions, so they stay inside code generation and can be pushed, pruned and folded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes in the order in which they are tried, and what must be left.
STEM_SUFFIXES = ("ing", "edly", "ed", "ies", "es", "ly", "s")
STEM_LEFT = 3
MIN_TOKEN = 3
#: Words that say nothing in a question.
STOPWORDS = """a an the and or but if then than that this these those of to in on at by for with from as is are was
were be been being it its am what which who whom whose when where why how do does did doing done can could should
would will shall may might must i me my we us our you your he she they them their there here about into over under
again more most some any all no not just really very please lets let tell show give got make made need want know
think say said now also still even only last week today yesterday tomorrow""".split()
#: Kinds and patterns of personal data, in the order of scrubbing.
PII_PATTERNS = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("PATH", r"(?:/Users/|/home/)[A-Za-z0-9_.-]+(?:/[^\s'\"]*)?"),
    ("PATH", r"[A-Za-z]:\\Users\\[A-Za-z0-9_.-]+(?:\\[^\s'\"]*)?"),
    ("API-KEY", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("API-KEY", r"\bgh[a-z]_[A-Za-z0-9]{20,}\b"),
    ("API-KEY", r"\bglpat-[A-Za-z0-9_-]{20,}\b"),
    ("API-KEY", r"\bAKIA[A-Z0-9]{16}\b"),
    ("PHONE", r"(?:\(\d{3}\)\s?|\b\d{3}[-.])\d{3}[-.]\d{4}\b"),
)
#: Credentials that make a text ineligible.
SECRET_PATTERNS = (
    r"\bsk-[A-Za-z0-9_-]{20,}",
    r"\bghp_[A-Za-z0-9]{36}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
#: Parameters of a URL that name no content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "mc_cid", "mc_eid")
#: Weights of note classes.
CLASS_WEIGHTS = {"fragment": 0.3, "status": 0.6, "staging": 0.3, "space": 0.3, "artifact": 0.3}


def ascii_borders(pattern: str) -> str:
    """``pattern`` with word borders of letters A-Z, digits and underscores, as in SQL; Java's own take accented letters
    for parts of words too."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def tokens(text: Column, least: int = MIN_TOKEN) -> Column:
    """Lower-case runs of letters and digits of at least ``least`` characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) >= least)


def stem(token: Column) -> Column:
    """The token without the first suffix of the list that leaves three characters or more."""
    out = token
    for s in reversed(STEM_SUFFIXES):
        fits = token.endswith(s) & (F.length(token) >= len(s) + STEM_LEFT)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(s))).otherwise(out)
    return out


def query_terms(text: Column, cap: int = 6) -> Column:
    """The content words of a question: no stopwords, no repeats, the first ``cap``."""
    words = F.array_distinct(F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS)))
    return F.slice(words, 1, cap)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def flat(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def first_sentence(text: Column, limit: int = 90, words: int = 12) -> Column:
    """Up to the first mark of a sentence's end before ``limit`` bytes, else the first words."""
    t = flat(text)
    head = F.regexp_extract(t, r"^([^.!?]*)[.!?]", 1)
    size = F.octet_length(head)
    return F.when((size > 0) & (size < limit), head).otherwise(F.array_join(F.slice(F.split(t, " "), 1, words), " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised_body(text: Column) -> Column:
    """Lines trimmed, blanks collapsed, empty lines dropped, in lower case."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: flat(x))
    return F.lower(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def fingerprint(text: Column) -> Column:
    return F.sha2(normalised_body(text), 256)


def identifier_parts(name: Column) -> Column:
    """Parts of snake, kebab, dotted and camel-case names."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(spaced, "[_.-]"), lambda p: p != "")


def scrub_pii(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[1], f"[REDACTED-{p[0]}]"), PII_PATTERNS, text)


def has_secret(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in SECRET_PATTERNS))


def strip_markup(text: Column) -> Column:
    """Without style and script blocks, image embeds, tags, rules of style, colours, URLs and entities."""
    patterns = (
        r"(?is)<style[^>]*>.*?</style>", r"(?is)<script[^>]*>.*?</script>", r"!\[[^\]]*\]\([^)]*\)", r"<[^>]+>",
        r"\{[^{}]*\}", r"#[0-9a-fA-F]{3,8}\b", r"https?://[^\s)]+", r"&[a-zA-Z#0-9]+;",
    )
    return flat(reduce(lambda t, p: F.regexp_replace(t, p, " "), patterns, text))


def head(raw: Column) -> Column:
    """The front matter of a markdown file, empty if there is none."""
    return F.regexp_extract(raw, r"(?s)\A---\n(.*?)\n---\n", 1)


def body(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?s)\A---\n.*?\n---\n", "")


def field(front: Column, key: str) -> Column:
    """A single-line value of the front matter without quotes; null if it is absent."""
    v = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.+)$", 1)
    return F.when(v != "", F.regexp_replace(F.trim(v), "^[\"']+|[\"']+$", ""))


def status(front: Column) -> Column:
    return F.lower(field(front, "status"))


def is_probe(front: Column) -> Column:
    return F.coalesce(F.lower(field(front, "probe")).isin("self-probe", "true", "yes"), F.lit(False))


def tag_list(value: Column) -> Column:
    """``[a, b]`` or ``a, b`` to its parts."""
    return F.filter(F.split(F.regexp_replace(value, r"^\s*\[|\]\s*$", ""), r"\s*,\s*"), lambda t: t != "")


def parse_time(value: Column) -> Column:
    """The first layout that fits."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(x)) for x in layouts))


def captured(front: Column, modified: Column) -> Column:
    """(time, where it comes from): ``captured``, else ``date``, else the time of change."""
    a, b = parse_time(field(front, "captured")), parse_time(field(front, "date"))
    return F.struct(
        F.coalesce(a, b, modified).alias("at"),
        F.when(a.isNotNull(), "frontmatter:captured").when(b.isNotNull(), "frontmatter:date").otherwise("mtime").alias("origin"),
    )


def outside_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", "")


def wiki_links(text: Column) -> Column:
    """Targets of wiki links outside fences, without section and caption, each once."""
    found = F.regexp_extract_all(outside_fences(text), F.lit(r"\[\[([^\]|#]+)"), 1)
    return F.array_distinct(F.transform(found, lambda t: F.trim(t)))


#: Issues of a named repository and bare ones of two digits and more, addresses of repositories, change lists
#: and abbreviated or full commit hashes.
NAMED_ISSUE, BARE_ISSUE = r"\b([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#\d+)\b", r"(?m)(?:^|[\s(\[])#(\d{2,})\b"
REPOSITORY, CHANGE, COMMIT = r"\bgithub\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)", r"\bcl/(\d+)\b", r"\b([0-9a-f]{7,40})\b"


def entity_uris(text: Column) -> Column:
    """Issues, repositories, change lists and commits that a text names outside fences, sorted, each once. A run of digits
    alone is no commit."""
    t = outside_fences(text)

    def found(pattern: str, kind: str, shown=lambda m: m) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), lambda m: F.concat(F.lit(kind), shown(m)))

    trimmed = lambda m: F.lower(F.regexp_replace(F.regexp_replace(m, r"\.git$", ""), r"[./-]+$", ""))
    repos = F.filter(found(REPOSITORY, "repo:", trimmed), lambda u: u.rlike("^repo:[^/]+/[^/]+$"))
    commits = F.filter(found(COMMIT, "commit:"), lambda u: F.substring_index(u, ":", -1).rlike("[a-f]"))
    every = F.concat(found(NAMED_ISSUE, "issue:", F.lower), found(BARE_ISSUE, "issue:#"), repos, found(CHANGE, "cl:"), commits)
    return F.array_sort(F.array_distinct(every))


def headings(text: Column) -> Column:
    """Titles of the headings outside fences, in order."""
    return F.regexp_extract_all(outside_fences(text), F.lit(r"(?m)^#{1,6} +(.+)$"), 1)


def split_path(path: Column) -> tuple[Column, Column]:
    """(folder, file name)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(path, "/?[^/]*$", ""), name


def truncated_slug(stem_: Column, words: tuple[str, ...] = ("the", "how", "why", "what", "not", "use", "add", "fix", "api")) -> Column:
    """Whether the first part of a slug is digits or short and no word of its own."""
    first = F.split(stem_, "-")[0]
    return first.rlike("^[0-9]+$") | ((F.octet_length(first) <= 4) & ~first.isin(*words))


def multiplier(flags: Column) -> Column:
    """The product of the class weights; a class without a weight counts one."""
    weights = F.create_map(*(F.lit(x) for kv in CLASS_WEIGHTS.items() for x in kv))
    return F.aggregate(flags, F.lit(1.0), lambda a, f: a * F.coalesce(F.element_at(weights, f), F.lit(1.0)))


def decay_stepped(days: Column) -> Column:
    """Fresh for half a year, then in steps; a negative age is fresh."""
    return F.when(days <= 182, 1.0).when(days <= 365, 0.5).when(days <= 1095, 0.125).otherwise(0.0625)


def decay_exponential(days: Column, half_life: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(days, F.lit(0)) / half_life)


def canonical_url(url: Column) -> Column:
    """Host in lower case, no default port, fragment or tracking parameters, parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    base = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)", 1)
    scheme, host = F.lower(F.substring_index(base, "://", 1)), F.lower(F.substring_index(base, "://", -1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+([^?]*)", 1)
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    sorted_ = F.array_join(F.array_sort(kept), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(sorted_ != "", F.concat(F.lit("?"), sorted_)).otherwise(""))


def source_identity(raw: Column, namespaces: tuple[str, ...] = ("url", "file", "transcript", "feed", "commit", "note")) -> Column:
    """``namespace:ref`` of a known namespace, or a URL; null for anything else."""
    s = F.regexp_replace(F.trim(raw), "^[\"']+|[\"']+$", "")
    space, ref = F.lower(F.trim(F.substring_index(s, ":", 1))), F.trim(F.regexp_replace(s, "^[^:]*:", ""))
    known = s.contains(":") & space.isin(*namespaces) & (ref != "")
    url = F.concat(F.lit("url:"), canonical_url(F.when(space == "url", ref).otherwise(s)))
    return F.when(F.lower(s).rlike("^https?://"), url).when(known & (space == "url"), url).when(known, F.concat(space, F.lit(":"), ref))


def excerpt(text: Column, needle: Column, around: int = 80) -> Column:
    """The text around the first place of ``needle``, with dots where it is cut."""
    at = F.locate(needle, text) if isinstance(needle, str) else F.expr("1")
    start = F.greatest(F.lit(1), at - around)
    size = at - start + F.length(F.lit(needle)) + around
    cut = F.substring(text, start, size)
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("…")).otherwise(""), cut, F.when(start + size <= F.length(text), F.lit("…")).otherwise("")))


def version_key(version: Column) -> Column:
    """A dotted version as numbers, padded to four; null if it is none."""
    parts = F.transform(F.split(version, r"\."), lambda p: p.cast("int"))
    padded = F.slice(F.concat(parts, F.array(*(F.lit(0) for _ in range(4)))), 1, 4)
    return F.when(version.rlike(r"^[0-9]+(\.[0-9]+)*$"), padded)
