"""Queries of the scalar layer: parsing, tokens, scrubbing, hashes, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.plans.book import Book
from quernel.sources.tables import MARKDOWN, NOTES, markdown, notes, table

BOOK = Book()
q = BOOK.query
_MD = f"WITH {NOTES}, {MARKDOWN}"
#: Stems in SQL, the suffixes one after another.
STEM_SQL = "CASE " + " ".join(f"WHEN t LIKE '%{s}' AND length(t) >= {len(s) + 3} THEN substr(t, 1, length(t) - {len(s)})" for s in X.STEM_SUFFIXES) + " ELSE t END"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"
TOKENS_SQL = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) >= 3)"


@q(f"SELECT doc_id, len({TOKENS_SQL.format(c='text')}) AS n_tokens, len(list_distinct({TOKENS_SQL.format(c='text')})) AS n_distinct FROM documents")
def text_tokens(spark, d):
    w = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@q(f"WITH t AS (SELECT doc_id, unnest({TOKENS_SQL.format(c='text')}) AS t FROM documents) SELECT {STEM_SQL} AS stem, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY 1")
def text_stems(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("t"))
    return t.groupBy(X.stem(F.col("t")).alias("stem")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@q(f"""WITH t AS (SELECT item_id, {TOKENS_SQL.format(c='text')} AS w FROM benchmark),
 u AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM t),
 f AS (SELECT item_id, t, min(i) AS i FROM u WHERE t NOT IN {STOP_SQL} GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM f)
 SELECT item_id, string_agg(t, ' ' ORDER BY k) AS terms FROM r WHERE k <= 6 GROUP BY 1""")
def text_query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms")).where("terms <> ''")


@q("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def text_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@q("SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def text_slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@q(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS t FROM documents),
 h AS (SELECT *, regexp_extract(t, '^([^.!?]*)[.!?]', 1) AS h FROM f)
 SELECT doc_id, CASE WHEN strlen(h) > 0 AND strlen(h) < 90 THEN h ELSE array_to_string(list_slice(string_split(t, ' '), 1, 12), ' ') END AS title FROM h""")
def text_first_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("title"))


@q("SELECT doc_id, sha256(text) AS hash FROM documents")
def text_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@q(r"""SELECT doc_id, sha256(lower(array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)),
 lambda x: trim(regexp_replace(x, '[ \t\n\r\f\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(10)))) AS fingerprint FROM documents""")
def text_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@q(r"""SELECT p_partkey, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(replace(p_name || 'Model_' || p_brand, ' ', ''), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '[_.-]'), lambda p: p <> ''), '|') AS parts FROM part""")
def text_identifier_parts(spark, d):
    name = F.replace(F.concat("p_name", F.lit("Model_"), "p_brand"), F.lit(" "), F.lit(""))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.identifier_parts(name), "|").alias("parts"))


def _scrub_sql(c: str) -> str:
    for kind, p in X.PII_PATTERNS:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '[REDACTED-{kind}]', 'g')"
    return c


_SECRETS = "'Call (212) 555-0199 or a.b@c.org, key sk-abcdefghijklmnopqrstuvwx in /home/ann/x.txt, ' || "


@q(f"SELECT doc_id, {_scrub_sql(_SECRETS + 'text')} AS scrubbed FROM documents")
def text_scrub_pii(spark, d):
    t = F.concat(F.lit(_SECRETS.split("'")[1]), F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.scrub_pii(t).alias("scrubbed"))


@q("SELECT doc_id, (" + " OR ".join(f"regexp_matches(t, '{p}')" for p in X.SECRET_PATTERNS) + ") AS has_secret FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || ' ghp_' || repeat('a1', 18) ELSE text END AS t FROM documents)")
def text_secret_gate(spark, d):
    t = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" ghp_" + "a1" * 18))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.has_secret(t).alias("has_secret"))


@q(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\{[^{}]*\}', ' ', 'g'),
 '#[0-9a-fA-F]{3,8}\b', ' ', 'g'), 'https?://[^\s)]+', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM pages""")
def text_strip_markup(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


@q(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages""")
def text_html_title(spark, d):
    c = lambda tag: F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1).alias("title" if tag == "title" else tag)
    return table(spark, d, "pages").select("page_id", c("title"), c("h1"))


@q(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)
 SELECT page_id, href, count(*) AS n FROM l WHERE starts_with(href, '/') GROUP BY 1, 2""")
def text_html_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    return links.where(F.col("href").startswith("/")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@q(r"""SELECT page_id, length(m) AS main_chars, length(html) >= 2000 AND length(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) < 500 AS js_shell
 FROM (SELECT page_id, html, coalesce(nullif(regexp_extract(html, '(?is)<main[^>]*>(.*?)</main>', 1), ''), regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)) AS m FROM pages)""")
def text_main_content(spark, d):
    part = lambda tag: F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    m = F.coalesce(F.nullif(part("main"), F.lit("")), part("article"))
    shell = (F.length("html") >= 2000) & (F.length(F.trim(F.regexp_replace("html", "<[^>]+>", ""))) < 500)
    return table(spark, d, "pages").select("page_id", F.length(m).cast("long").alias("main_chars"), shell.alias("js_shell"))


@q(r"""WITH u AS (SELECT page_id, regexp_replace(trim(replace(url, 'example', 'EXAMPLE')) || '&utm_source=x&b=2', '#.*$', '') AS u FROM pages),
 p AS (SELECT page_id, regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)', 1) AS base, regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+([^?]*)', 1) AS path, regexp_extract(u, '\?(.*)$', 1) AS query FROM u),
 k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','fbclid','gclid','mc_cid','mc_eid'], lower(split_part(p, '=', 1))))), '&') AS kept FROM p)
 SELECT page_id, lower(base) || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM k""")
def text_canonical_url(spark, d):
    u = F.concat(F.replace("url", F.lit("example"), F.lit("EXAMPLE")), F.lit("&utm_source=x&b=2"))
    return table(spark, d, "pages").select("page_id", X.canonical_url(u).alias("url"))


@q("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'feed:' || CAST(page_id AS VARCHAR) WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'file:a.md' END AS identity FROM pages""")
def text_source_identity(spark, d):
    i = F.col("page_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit(" 'Feed: "), i.cast("string"), F.lit("'"))).when(i % 4 == 1, "no namespace").when(i % 4 == 2, "blob:x").otherwise("file:a.md")
    return table(spark, d, "pages").select("page_id", X.source_identity(raw).alias("identity"))


@q(_MD + r""" SELECT doc_id, regexp_extract(raw, '(?s)\A---\n(.*?)\n---\n', 1) AS head, length(regexp_replace(raw, '(?s)\A---\n.*?\n---\n', '')) AS body_chars FROM md""")
def note_frontmatter(spark, d):
    return markdown(spark, d).select("doc_id", X.head(F.col("raw")).alias("head"), F.length(X.body(F.col("raw"))).cast("long").alias("body_chars"))


@q(_MD + r""" SELECT doc_id, 'Note ' || CAST(doc_id AS VARCHAR) AS title,
 CASE doc_id % 10 WHEN 0 THEN 'superseded' WHEN 1 THEN 'inbox' WHEN 2 THEN 'unfiled' ELSE 'active' END AS status,
 doc_id % 8 = 0 AS probe, CAST(regexp_extract(raw, '(?m)^captured: (.+)$', 1) AS TIMESTAMP) AS captured, 'frontmatter:captured' AS origin,
 regexp_replace(regexp_extract(raw, '(?m)^tags: \[(.+)\]$', 1), ', ', '|') AS tags FROM md""")
def note_parse(spark, d):
    h = X.head(F.col("raw"))
    at = X.captured(h, F.lit("2020-01-01").cast("timestamp"))
    return markdown(spark, d).select(
        "doc_id", X.field(h, "title").alias("title"), X.status(h).alias("status"), X.is_probe(h).alias("probe"),
        at["at"].alias("captured"), at["origin"].alias("origin"), F.array_join(X.tag_list(X.field(h, "tags")), "|").alias("tags"),
    )


@q(_MD + r""" SELECT doc_id, array_to_string(list_distinct(list_transform(regexp_extract_all(regexp_replace(raw, '(?s)```.*?```', '', 'g'), '\[\[([^\]|#]+)', 1), lambda t: trim(t))), '|') AS links FROM md""")
def note_wiki_links(spark, d):
    return markdown(spark, d).select("doc_id", F.array_join(X.wiki_links(F.col("raw")), "|").alias("links"))


#: What names entities, besides what the notes hold.
_NAMING = "raw || ' Fixed in Acme/Tool#' || CAST(doc_id AS VARCHAR{n}) || ' and (#' || CAST(doc_id AS VARCHAR{n}) || ') by ' || left({sha}, 10) || ' at https://github.com/Acme/Tool' || CAST(doc_id % 9 AS VARCHAR{n}) || '.git or github.com/x/, not 20240102; cl/' || CAST(doc_id AS VARCHAR{n}) || chr(10)"


@q(_MD + ", t AS (SELECT doc_id, regexp_replace(" + _NAMING.format(n="", sha="sha256(CAST(doc_id AS VARCHAR))") + r""", '(?s)```.*?```', '', 'g') AS t FROM md),
 u AS (SELECT doc_id, unnest(list_concat(list_transform(regexp_extract_all(t, '\b([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#\d+)\b', 1), lambda m: 'issue:' || lower(m)), list_transform(regexp_extract_all(t, '(?m)(?:^|[\s(\[])#(\d{2,})\b', 1), lambda m: 'issue:#' || m),
 list_filter(list_transform(regexp_extract_all(t, '\bgithub\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)', 1), lambda m: 'repo:' || lower(regexp_replace(regexp_replace(m, '\.git$', ''), '[./-]+$', ''))), lambda u: regexp_matches(u, '^repo:[^/]+/[^/]+$')),
 list_transform(regexp_extract_all(t, '\bcl/(\d+)\b', 1), lambda m: 'cl:' || m), list_transform(list_filter(regexp_extract_all(t, '\b([0-9a-f]{7,40})\b', 1), lambda m: regexp_matches(m, '[a-f]')), lambda m: 'commit:' || m))) AS uri FROM t)
 SELECT uri, count(DISTINCT doc_id) AS mentions FROM u GROUP BY 1""")
def note_entities(spark, d):
    raw = markdown(spark, d).select("doc_id", F.expr(_NAMING.format(n="(20)", sha="sha2(CAST(doc_id AS STRING), 256)")).alias("raw"))
    e = raw.select("doc_id", F.explode(X.entity_uris(F.col("raw"))).alias("uri"))
    return e.groupBy("uri").agg(F.count_distinct("doc_id").alias("mentions"))


@q(_MD + r""" SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(raw, '(?s)```.*?```', '', 'g'), '(?m)^#{1,6} +(.+)$', 1), ' > ') AS headings FROM md""")
def note_headings(spark, d):
    return markdown(spark, d).select("doc_id", F.array_join(X.headings(F.col("raw")), " > ").alias("headings"))


@q(f"""WITH {NOTES} SELECT path, regexp_replace(path, '/?[^/]*$', '') AS folder, string_split(path, '/')[-1] AS file, string_split(path, '/')[1] IN ('_inbox', '_archive') AS set_aside FROM notes""")
def note_path_split(spark, d):
    folder, name = X.split_path(F.col("path"))
    return notes(spark, d).select("path", folder.alias("folder"), name.alias("file"), F.split("path", "/")[0].isin("_inbox", "_archive").alias("set_aside"))


@q(f"""WITH {NOTES} SELECT doc_id, round(CASE WHEN list_contains(flags, 'space') THEN 0.3 ELSE 1 END * CASE WHEN list_contains(flags, 'fragment') THEN 0.3 ELSE 1 END
 * CASE WHEN list_contains(flags, 'artifact') THEN 0.3 ELSE 1 END * CASE WHEN list_contains(flags, 'status') THEN 0.6 ELSE 1 END, 6)::DOUBLE AS multiplier FROM notes""")
def note_class_multiplier(spark, d):
    return notes(spark, d).select("doc_id", F.round(X.multiplier(F.col("flags")), 6).alias("multiplier"))


@q(f"""WITH {NOTES}, a AS (SELECT doc_id, date_diff('day', coalesce(updated, CASE WHEN captured_src = 'frontmatter' THEN captured END), TIMESTAMP '2026-01-01') AS days FROM notes)
 SELECT doc_id, days, CASE WHEN days <= 182 THEN 1.0 WHEN days <= 365 THEN 0.5 WHEN days <= 1095 THEN 0.125 ELSE 0.0625 END::DOUBLE AS stepped,
 round(pow(0.5, greatest(days, 0) / 30.0), 9)::DOUBLE AS exponential FROM a WHERE days IS NOT NULL""")
def note_decay(spark, d):
    anchor = F.coalesce("updated", F.when(F.col("captured_src") == "frontmatter", F.col("captured")))
    days = F.datediff(F.lit("2026-01-01").cast("date"), anchor).cast("long")
    return notes(spark, d).select("doc_id", days.alias("days")).where("days is not null").select(
        "doc_id", "days", X.decay_stepped(F.col("days")).alias("stepped"), F.round(X.decay_exponential(F.col("days")), 9).alias("exponential")
    )


@q("""SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN s > 1 THEN '…' ELSE '' END || substr(text, s, z) || CASE WHEN s + z <= length(text) THEN '…' ELSE '' END END AS excerpt
 FROM (SELECT *, p - s + length('the') + 80 AS z FROM (SELECT *, greatest(1, p - 80) AS s FROM (SELECT doc_id, text, instr(text, 'the') AS p FROM documents)))""")
def text_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text"), "the").alias("excerpt"))


@q("""SELECT a.p_partkey AS p_partkey, [a.p_size, a.p_partkey % 7, 0, 0] >= [20, 3, 0, 0] AS at_least FROM part a""")
def text_version_match(spark, d):
    v = X.version_key(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")))
    return table(spark, d, "part").select("p_partkey", (v >= X.version_key(F.lit("20.3"))).alias("at_least"))


@q("SELECT doc_id, substr(text, 1, 300) AS head, length(text) > 300 AS clipped, octet_length(encode(text)) <= 32768 AS fits FROM documents")
def text_bounded_head(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("head"), (F.length("text") > 300).alias("clipped"), (F.octet_length("text") <= 32768).alias("fits"))
