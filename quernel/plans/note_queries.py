"""Queries of note classes, typed links, checks of the corpus against itself, and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import aliases, chunking, integrity, rules, signals, snapshots
from quernel.operators.loops import scratch
from quernel.plans.book import Book
from quernel.sources.tables import LINKS, NOTES, markdown, note_links, notes, table

BOOK = Book()
q = BOOK.query

#: Notes as files whose openings, tiers, kinds and folders vary by id.
_RAW = f"""{NOTES}, rw AS (SELECT doc_id, status, CASE WHEN doc_id % 19 = 0 THEN 'personal/idea/' || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'the' END || '-' || stem || '.md' WHEN doc_id % 23 = 0 THEN 'a/Decisions/' || stem || '.md' WHEN doc_id % 29 = 0 THEN '_dream-staging/' || stem || '.proposal.md' ELSE path END AS path,
 '---' || chr(10) || 'status: ' || status || CASE WHEN doc_id % 5 = 1 THEN chr(10) || 'kind: Failure-Incident' ELSE '' END || CASE WHEN doc_id % 31 = 0 THEN chr(10) || 'lifecycle_tier: "durable"' ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN chr(10) || 'altitude: artifact' ELSE '' END || CASE WHEN doc_id % 37 = 0 THEN chr(10) || 'mining_confidence: 0.4' ELSE '' END
 || CASE WHEN doc_id % 10 = 3 THEN chr(10) || 'supersedes: n' || CAST(doc_id - 3 AS VARCHAR) ELSE '' END || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 13 = 0 THEN 'User stated: ' WHEN doc_id % 11 = 0 THEN '... ' ELSE '' END || body || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'This depends on [[n1]].' WHEN 1 THEN 'It was fixed in [[n2#a|b]] and `[[n9]]`.' WHEN 2 THEN 'See [[n3]].' ELSE 'Never do this. You must always do that.' END AS raw FROM notes)"""


def _raw(spark, d):
    n, i = notes(spark, d), F.col("doc_id")
    s = i.cast("string")
    path = (
        F.when(i % 19 == 0, F.concat(F.lit("personal/idea/"), F.when(i % 2 == 0, "x").otherwise("the"), F.lit("-"), "stem", F.lit(".md")))
        .when(i % 23 == 0, F.concat(F.lit("a/Decisions/"), "stem", F.lit(".md"))).when(i % 29 == 0, F.concat(F.lit("_dream-staging/"), "stem", F.lit(".proposal.md"))).otherwise(F.col("path"))
    )
    line = lambda c, v: F.when(c, F.lit(f"\n{v}")).otherwise("")
    end = F.when(i % 4 == 0, "This depends on [[n1]].").when(i % 4 == 1, "It was fixed in [[n2#a|b]] and `[[n9]]`.").when(i % 4 == 2, "See [[n3]].").otherwise("Never do this. You must always do that.")
    raw = F.concat(
        F.lit("---\nstatus: "), "status", line(i % 5 == 1, "kind: Failure-Incident"), line(i % 31 == 0, 'lifecycle_tier: "durable"'), line(i % 17 == 0, "altitude: artifact"), line(i % 37 == 0, "mining_confidence: 0.4"),
        F.when(i % 10 == 3, F.concat(F.lit("\nsupersedes: n"), (i - 3).cast("string"))).otherwise(""), F.lit("\n---\n"), F.when(i % 13 == 0, "User stated: ").when(i % 11 == 0, "... ").otherwise(""), "body", F.lit("\n"), end,
    )
    return n.select("doc_id", "status", path.alias("path"), raw.alias("raw"), "stem", s.alias("id"))


_BODY = "regexp_replace(raw, '(?s)\\A---\\n.*?\\n---\\n', '')"
_SHORT = "((regexp_matches(split_part(split_part(path, '/', 3), '-', 1), '^[0-9]+$') OR (strlen(split_part(split_part(path, '/', 3), '-', 1)) <= 4 AND split_part(split_part(path, '/', 3), '-', 1) NOT IN ('the', 'how', 'why', 'what', 'not', 'use', 'add', 'fix', 'api'))))"
_SIGNALS = f"""sg AS (SELECT *, starts_with(ltrim({_BODY}, ' ' || chr(9) || chr(10) || chr(13)), 'User stated:') OR starts_with(ltrim({_BODY}, ' ' || chr(9) || chr(10) || chr(13)), 'Fix observed:') AS lead_in, regexp_matches(regexp_extract(raw, '(?s)\\A---\\n(.*?)\\n---\\n', 1), '(?m)^mining_confidence:') AS mining_confidence,
 starts_with(path, 'personal/idea/') AND ({_SHORT} OR starts_with({_BODY}, '...')) AS truncated_slug,
 regexp_matches(raw, '(?m)\\A(---\\n[^\\n]*\\n(?:[a-z_]+: [^\\n]*\\n)*)') AS has_head, doc_id % 5 = 1 OR doc_id % 31 = 0 OR path LIKE 'a/Decisions/%' AS durable FROM rw)"""


@q(f"WITH {_RAW}, {_SIGNALS} SELECT doc_id, lead_in, mining_confidence, truncated_slug FROM sg")
def note_fragment_signals(spark, d):
    n = _raw(spark, d)
    return n.select("doc_id", *(c.alias(k) for k, c in signals.fragment_signals(F.col("path"), F.col("raw")).items()))


@q(f"""WITH {_RAW}, {_SIGNALS} SELECT doc_id, array_to_string(list_filter([CASE WHEN split_part(path, '/', 1) IN ('_inbox', '_archive') THEN 'space' END, CASE WHEN durable THEN 'durable' END, CASE WHEN doc_id % 17 = 0 THEN 'artifact' END,
 CASE WHEN lead_in OR mining_confidence OR truncated_slug THEN CASE WHEN status = 'active' THEN 'fragment-promoted' ELSE 'fragment' END END, CASE WHEN status IN ('unfiled', 'inbox', 'superseded') THEN 'status' END,
 CASE WHEN starts_with(path, '_dream-staging/') THEN 'staging' END], lambda f: f IS NOT NULL), '|') AS classes FROM sg""")
def note_classes(spark, d):
    return _raw(spark, d).select("doc_id", F.array_join(signals.note_classes(F.col("path"), F.col("raw")), "|").alias("classes"))


@q(f"WITH {_RAW}, {_SIGNALS} SELECT doc_id, durable FROM sg")
def note_durable(spark, d):
    return _raw(spark, d).select("doc_id", signals.durable(F.col("path"), F.col("raw")).alias("durable"))


_CUES = "CASE " + " ".join("WHEN regexp_matches(w, '{}') THEN '{}'".format(p.replace("'", "''"), t) for t, p in signals.EDGE_CUES) + " ELSE 'references' END"


@q(f"""WITH {_RAW}, t AS (SELECT doc_id, regexp_replace(raw, '`[^`\\n]*`', '', 'g') AS t FROM rw WHERE doc_id % 4 <> 3), p AS (SELECT *, instr(t, '[[') AS p, regexp_extract(t, '\\[\\[([^\\]|#]+)[^\\]]*\\]\\]', 1) AS target, length(regexp_extract(t, '\\[\\[[^\\]]*\\]\\]', 0)) AS n FROM t),
 w AS (SELECT *, substr(t, greatest(1, p - 160), p - greatest(1, p - 160) + n + 90) AS w FROM p) SELECT doc_id, target, {_CUES} AS edge_type FROM w UNION ALL SELECT doc_id, 'n' || CAST(doc_id - 3 AS VARCHAR), 'supersedes' FROM rw WHERE doc_id % 10 = 3""")
def note_typed_edges(spark, d):
    return signals.typed_edges(_raw(spark, d), "raw", "doc_id").drop("place")


_SENTENCES = "unnest(list_filter(string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))"
_POLARITY = f"CASE WHEN regexp_matches(s, '{signals.ASKS}') AND NOT regexp_matches(s, '{signals.FORBIDS.replace(chr(39), chr(39) * 2)}') THEN 'positive' WHEN NOT regexp_matches(s, '{signals.ASKS}') AND regexp_matches(s, '{signals.FORBIDS.replace(chr(39), chr(39) * 2)}') THEN 'negative' END"


@q(f"WITH {_RAW}, s AS (SELECT doc_id, {_SENTENCES.format(t='raw')} AS s FROM rw), p AS (SELECT doc_id, {_POLARITY} AS polarity FROM s) SELECT doc_id, polarity, count(*) AS n FROM p WHERE polarity IS NOT NULL GROUP BY ALL")
def note_polarity(spark, d):
    s = _raw(spark, d).select("doc_id", F.explode(signals.sentences(F.col("raw"))).alias("s"))
    return s.withColumn("polarity", signals.polarity(F.col("s"))).where("polarity is not null").groupBy("doc_id", "polarity").agg(F.count("*").alias("n"))


#: Rules in prose: what each note says besides its body.
_SAID = ("You must always run the tests.", "Never run tests by hand! It is fine.", "Don't merge a branch.", "A merge is always required. Do not deploy.", "The design must never change.", "Always deploy on review.")
_SAY = "CASE doc_id % 6 " + " ".join("WHEN {} THEN '{}'".format(i, x.replace("'", "''")) for i, x in enumerate(_SAID)) + " END"
_OWN = r"regexp_replace(s, '^\s+|\s+$', '', 'g')"


@q(f"""WITH n AS (SELECT doc_id, source, string_split(regexp_replace(text || chr(10) || {_SAY}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
 c AS (SELECT doc_id, source, list_filter(list_transform(l, lambda s: {_OWN}), lambda s: s <> '') AS l FROM n), u AS (SELECT doc_id, source, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS place FROM c),
 p AS (SELECT *, {_POLARITY} AS polarity, unnest(list_distinct(regexp_extract_all(lower(s), '{rules.ANCHORS}'))) AS anchor FROM u),
 j AS (SELECT e.doc_id, b.doc_id AS base, b.place, b.s, row_number() OVER (PARTITION BY e.doc_id ORDER BY b.doc_id, b.place) AS k FROM p e JOIN p b ON e.anchor = b.anchor AND e.polarity <> b.polarity AND e.doc_id <> b.doc_id WHERE b.source = 'src3')
 SELECT doc_id, base, CAST(place AS INT) AS place, s AS sentence FROM j WHERE k = 1""")
def rules_contradicted(spark, d):
    n = table(spark, d, "documents").select("doc_id", "source", F.concat("text", F.lit("\n"), F.expr(_SAY)).alias("text"))
    return rules.contradicted(n, n.where("source = 'src3'"), "text", "doc_id")


@q("""SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: '"' || t || '"'), ' ') AS expression FROM benchmark""")
def search_expression(spark, d):
    return table(spark, d, "benchmark").select("item_id", signals.quoted_terms(F.col("text")).alias("expression"))


_BOUNDS = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'soon' END"


@q(f"WITH b AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS bound FROM events) SELECT event_id, bound, CASE WHEN bound IS NULL THEN true ELSE ts >= bound AND ts < bound + INTERVAL 9 HOUR END AS inside FROM b")
def search_bounds(spark, d):
    i = F.col("event_id") % 4
    f = lambda p: F.date_format("ts", p)
    typed = F.when(i == 0, f("yyyy-MM-dd")).when(i == 1, f("yyyy-MM-dd'T'HH:mm:ss")).when(i == 2, F.concat(F.lit(" "), f("yyyy-MM-dd HH:mm:ss"))).otherwise("soon")
    e = table(spark, d, "events").select("event_id", "ts", signals.bound(typed).alias("bound"))
    return e.select("event_id", "bound", signals.within(F.col("ts"), F.col("bound"), F.col("bound") + F.expr("INTERVAL 9 HOURS")).alias("inside"))


@q(f"WITH {NOTES}, c AS (SELECT stem AS new, 'n' || CAST(doc_id * 2 AS VARCHAR) AS old FROM notes) SELECT new, old, CASE WHEN n.status IS NULL THEN 'missing' ELSE 'still active' END AS finding FROM c LEFT JOIN notes n ON n.stem = c.old WHERE n.status IS NULL OR n.status = 'active'")
def supersede_integrity(spark, d):
    n = notes(spark, d)
    claims = n.select(F.col("stem").alias("new"), F.concat(F.lit("n"), (F.col("doc_id") * 2).cast("string")).alias("old"))
    return integrity.supersede_findings(claims, n.select(F.col("stem").alias("note"), "status"))


@q(f"WITH {NOTES} SELECT stem AS note FROM notes WHERE status = 'superseded' AND doc_id NOT IN (SELECT doc_id * 4 FROM notes)")
def supersede_dangling(spark, d):
    n = notes(spark, d)
    claims = n.select(F.concat(F.lit("n"), (F.col("doc_id") * 4).cast("string")).alias("old"))
    return integrity.unclaimed(claims, n.select(F.col("stem").alias("note"), "status"))


@q("WITH t AS (SELECT DISTINCT upper(c_name) AS target FROM customer), k AS (SELECT lower(c_name) AS k, min(c_name) AS name FROM customer GROUP BY 1 HAVING count(DISTINCT c_name) = 1) SELECT target, name FROM t JOIN k ON lower(target) = k WHERE target <> name")
def link_case_repair(spark, d):
    c = table(spark, d, "customer")
    return integrity.repaired_targets(c.select(F.upper("c_name").alias("target")), c.select(F.col("c_name").alias("name")))


@q("SELECT p.page_id, f.twin FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages) p JOIN (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS h, min(page_id) AS twin, count(*) AS n FROM pages GROUP BY 1) f USING (h) WHERE n > 1 AND page_id > twin")
def source_twins(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return integrity.shared_source(table(spark, d, "pages").select("page_id", host.alias("host")), "page_id", "host")


@q("SELECT source, count(*) AS n, max(doc_id) AS latest FROM documents GROUP BY 1")
def source_provenance(spark, d):
    return integrity.provenance(table(spark, d, "documents"), "source", "doc_id", "doc_id")


@q(f"WITH {NOTES}, {LINKS}, i AS (SELECT n.path, count(DISTINCT source_path) AS incoming FROM links l JOIN notes n ON l.target = n.stem OR l.target = n.path GROUP BY 1), o AS (SELECT source_path AS path, count(*) AS outgoing FROM links GROUP BY 1) SELECT path, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing FROM notes LEFT JOIN i USING (path) LEFT JOIN o USING (path)")
def graph_neighbours(spark, d):
    edges = note_links(spark, d).select(F.col("source_path").alias("source"), "target")
    return integrity.neighbours(edges, notes(spark, d).select("path", "stem"))


@q(f"WITH {NOTES}, {LINKS}, l2 AS (SELECT * FROM links WHERE NOT (starts_with(target, 'n') AND source_stem < 'n3')), c AS (SELECT DISTINCT source_path AS path FROM l2 WHERE NOT starts_with(target, 'series')) SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM c) AS connected, (SELECT count(*) FROM c)::DOUBLE / (SELECT count(*) FROM notes) AS share, (SELECT count(*) FROM l2 WHERE starts_with(target, 'series')) AS generated")
def graph_connectivity(spark, d):
    l = note_links(spark, d).where(~(F.col("target").startswith("n") & (F.col("source_stem") < "n3")))
    return integrity.connectivity(notes(spark, d).select("path"), l.select(F.col("source_path").alias("source"), "target"), F.col("target").startswith("series"))


@q("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def ledger_forget(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    return integrity.without(e, e.where("event_id % 97 = 0"), ["user_id"])


_NOW = "TIMESTAMP '2024-01-20'"


@q(f"""WITH j AS (SELECT user_id AS job, CASE WHEN user_id % 7 = 0 THEN NULL ELSE min(ts) END AS last, max(ts) AS nxt FROM events GROUP BY 1) SELECT job, CASE WHEN last IS NULL THEN 'due' WHEN last < nxt AND nxt <= {_NOW} AND epoch({_NOW}) - floor(epoch(nxt)) <= 86400 THEN 'due' WHEN last < nxt AND epoch({_NOW}) - floor(epoch(nxt)) > 86400 THEN 'missed' ELSE 'waiting' END AS state,
 last IS NULL OR epoch({_NOW}) - floor(epoch(last)) >= 400 * 3600 AS cooled FROM j""")
def job_schedule(spark, d):
    j = table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.min("ts").alias("last"), F.max("ts").alias("at")).withColumn("last", F.when(F.col("job") % 7 != 0, F.col("last")))
    now = F.lit("2024-01-20").cast("timestamp")
    return j.select("job", integrity.job_due(F.col("last"), F.col("at"), now, 86400).alias("state"), integrity.cooled(F.col("last"), now, 400).alias("cooled"))


_AUDIT = "smp AS (SELECT user_id % 12 AS job, event_type AS cheap, CASE WHEN event_id % (user_id % 12 + 2) = 0 THEN 'other' WHEN event_id % 50 = 1 THEN NULL ELSE event_type END AS strong FROM events), ag AS (SELECT job, count(*) AS sampled, avg((cheap = strong)::INT)::DOUBLE AS rate FROM smp WHERE strong IS NOT NULL GROUP BY 1)"


def _agreement(spark, d):
    i, job = F.col("event_id"), F.col("user_id") % 12
    strong = F.when(i % (job + 2) == 0, "other").when(i % 50 != 1, F.col("event_type"))
    return integrity.agreement(table(spark, d, "events").select(job.alias("job"), F.col("event_type").alias("cheap"), strong.alias("strong")))


@q(f"WITH {_AUDIT} SELECT job, sampled, round(rate, 9) AS rate, sampled >= 25 AND rate >= 0.9 AS meets FROM ag")
def tier_agreement(spark, d):
    return _agreement(spark, d).withColumn("rate", F.round("rate", 9))


@q(f"WITH {_AUDIT}, jb AS (SELECT r AS job, r % 6 = 5 AS pinned FROM range(16) t(r)), au AS (SELECT *, CASE WHEN job % 4 = 0 THEN 'v1' ELSE 'v2' END AS version FROM ag) SELECT job, CASE WHEN why = 'qualified' THEN 'cheap' ELSE 'strong' END AS tier, why FROM (SELECT jb.job, CASE WHEN pinned THEN 'pinned' WHEN version IS NULL THEN 'no audit' WHEN version <> 'v2' THEN 'stale' WHEN sampled < 25 OR rate < 0.9 THEN 'below bar' ELSE 'qualified' END AS why FROM jb LEFT JOIN au USING (job))")
def tier_routing(spark, d):
    audits = _agreement(spark, d).withColumn("version", F.when(F.col("job") % 4 == 0, "v1").otherwise("v2"))
    jobs = spark.range(16).select(F.col("id").alias("job"), (F.col("id") % 6 == 5).alias("pinned"))
    return integrity.route(jobs, audits, "v2")


@q("WITH s AS (SELECT l_returnflag AS axis, avg(l_quantity) AS score FROM lineitem GROUP BY 1), b AS (SELECT o_orderstatus AS axis, avg(o_totalprice) AS score FROM orders GROUP BY 1) SELECT s.axis, round(s.score, 6) AS score, round(b.score, 6) AS baseline, coalesce(s.score < b.score - 3, false) AS red FROM s LEFT JOIN b USING (axis)")
def health_regressions(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("axis")).agg(F.avg("l_quantity").alias("score"))
    b = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("axis")).agg(F.avg("o_totalprice").alias("score"))
    return integrity.regressions(s, b).select("axis", F.round("score", 6).alias("score"), F.round("baseline", 6).alias("baseline"), "red")


@q("WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) SELECT term, count(*) AS df, round(ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))), 9) AS idf FROM t GROUP BY 1")
def term_idf(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    return integrity.term_idf(table(spark, d, "documents"), "doc_id", words).withColumn("idf", F.round("idf", 9))


@q("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 40) ORDER BY doc_id")
def unfiled_sample(spark, d):
    return integrity.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 40, 7)


@q("WITH r AS (SELECT o_custkey AS question, o_orderpriority AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), g AS (SELECT c_custkey AS question, '1-URGENT' AS item FROM customer) SELECT g.question, min(rank) AS best_rank FROM g LEFT JOIN r USING (question, item) GROUP BY 1")
def eval_best_rank(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderpriority").alias("item"), F.row_number().over(order).alias("rank"))
    return integrity.best_ranks(r, table(spark, d, "customer").select(F.col("c_custkey").alias("question"), F.lit("1-URGENT").alias("item")))


@q("WITH RECURSIVE w(plan, level) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT plan + 1, level + 1 FROM w WHERE (plan + 1) % 10 <> 1 AND plan + 1 <= (SELECT max(c_custkey) FROM customer)) SELECT plan, level FROM w WHERE plan % 10 <> 0")
def plan_merge_order(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("plan"))
    # Each needs the one before it in its ten; the tenth needs itself.
    needs = c.where("plan % 10 <> 1").select("plan", (F.col("plan") - 1).alias("needs")).unionByName(c.where("plan % 10 = 0").select("plan", F.col("plan").alias("needs")))
    return integrity.merge_order(c, needs)[0]


#: Titles and bodies in ASCII, so that SQL can count bytes as characters.
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"
_TRIM = "regexp_replace(regexp_replace({t}, '^[ \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F]+', ''), '[ \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F]+$', '')"


@q(f"""WITH d AS (SELECT doc_id, {_TRIM.format(t=f"left({_ASCII}, CASE WHEN doc_id % 9 = 0 THEN 320 ELSE 10 END)")} AS t, {_TRIM.format(t=_ASCII)} AS b FROM documents), p AS (SELECT *, CASE WHEN t <> '' AND b <> '' THEN t || chr(10) || chr(10) || b ELSE t || b END AS whole, CASE WHEN t <> '' THEN t || chr(10) || chr(10) ELSE '' END AS prefix FROM d),
 r AS (SELECT *, 298 - length(prefix) AS room, 298 - length(prefix) - (298 - length(prefix)) // 10 AS step FROM p), n AS (SELECT *, CASE WHEN length(whole) <= 298 OR room <= 0 THEN 1 ELSE 1 + CAST(ceil(greatest(0, length(b) - room) / CAST(step AS DOUBLE)) AS INT) END AS n FROM r),
 x AS (SELECT *, unnest(range(n)) AS i FROM n) SELECT doc_id, CAST(i AS INT) AS chunk_idx, CASE WHEN length(whole) <= 298 THEN whole WHEN room <= 0 THEN left(whole, 298) ELSE prefix || substr(b, i * step + 1, room) END AS content FROM x""")
def chunk_windows(spark, d):
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    title = F.left(ascii_, F.when(F.col("doc_id") % 9 == 0, 320).otherwise(10))
    return chunking.window_chunks(table(spark, d, "documents").select("doc_id", title.alias("title"), ascii_.alias("text")), "title", "text", "doc_id", 298)


@q()
def chunk_two_level(spark, d):
    return chunking.build_chunks(markdown(spark, d), "stem", "raw", "doc_id", 900)


@q("""WITH a AS (SELECT p_partkey, list_filter([p_brand, p_type, ' ', upper(p_brand), lower(p_type), split_part(p_name, ' ', 1), 'X', 'x'], lambda a: trim(a) <> '') AS a FROM part), l AS (SELECT *, list_transform(a, lambda x: lower(x)) AS l FROM a),
 u AS (SELECT p_partkey, unnest(a) AS a, unnest(l) AS l, generate_subscripts(a, 1) AS i FROM l), f AS (SELECT p_partkey, a, i, row_number() OVER (PARTITION BY p_partkey, l ORDER BY i) AS k FROM u) SELECT p_partkey, string_agg(a, '|' ORDER BY i) AS aliases FROM f WHERE k = 1 GROUP BY 1""")
def alias_merge(spark, d):
    merged = signals.merged_aliases(F.array("p_brand", "p_type", F.lit(" ")), F.array(F.upper("p_brand"), F.lower("p_type"), F.split("p_name", " ")[0], F.lit("X"), F.lit("x")))
    return table(spark, d, "part").select("p_partkey", F.array_join(merged, "|").alias("aliases"))


_WORDS = "list_filter(string_split_regex(lower({t}), '\\s+'), lambda w: w <> '')"
_FIRSTS = "array_to_string(list_transform({w}, lambda w: regexp_extract(w, '\\pL', 0)), '')"
_ALIAS = "CASE p_partkey % 6 WHEN 0 THEN upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), '')) WHEN 1 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') WHEN 2 THEN 'no such words 77' WHEN 3 THEN ' ' WHEN 4 THEN 'q' ELSE left(p_name, 6) || 'zz' END"


@q(f"""WITH a AS (SELECT p_partkey, p_name, {_ALIAS} AS alias FROM part), l AS (SELECT *, lower(trim(alias)) AS al, lower(p_name) AS s, regexp_replace(lower(trim(alias)), '\\PL', '', 'g') AS letters, {_WORDS.format(t='trim(alias)')} AS named, {_WORDS.format(t='p_name')} AS words, list_filter(string_split_regex(lower(trim(alias)), '[^\\pL\\pN]+'), lambda w: w <> '') AS pieces FROM a)
 SELECT p_partkey, al <> '' AND (length(al) < 3 OR contains(s, al) OR (length(letters) BETWEEN 2 AND 6 AND contains({_FIRSTS.format(w='words')}, letters)) OR (len(named) BETWEEN 2 AND 6 AND list_contains(words, {_FIRSTS.format(w='named')})) OR (len(pieces) > 1 AND len(list_filter(pieces, lambda w: length(w) >= 3 AND NOT contains(s, w))) = 0)) AS derivable FROM l""")
def alias_derivable(spark, d):
    name = F.col("p_name")
    i, words = F.col("p_partkey") % 6, F.split(name, " ")
    alias = (
        F.when(i == 0, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))).when(i == 1, F.array_join(F.reverse(words), " "))
        .when(i == 2, "no such words 77").when(i == 3, " ").when(i == 4, "q").otherwise(F.concat(F.substring(name, 1, 6), F.lit("zz")))
    )
    return table(spark, d, "part").select("p_partkey", aliases.derivable(alias, name).alias("derivable"))


#: Bodies with names of the kinds that aliases come from.
def _named(spark, d):
    i = F.col("doc_id").cast("string")
    more = F.concat(F.lit("\nThe Open Knowledge Format (OKF) and BM25 (best match), see idx_"), i, F.lit("_desc, noteType and `a-kebab-name"), i, F.lit("`."))
    return notes(spark, d).select("doc_id", "title", F.concat("body", more).alias("body"))


@q()
def alias_derived(spark, d):
    return aliases.derived_aliases(_named(spark, d), "title", "body", "doc_id")


@q()
def alias_acronyms(spark, d):
    return aliases.acronyms(_named(spark, d), "title", "body", "doc_id")


@q("SELECT p_partkey, upper(array_to_string(list_transform(list_filter(string_split_regex(p_name, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: substr(w, 1, 1)), '')) AS acronym FROM part")
def alias_initials(spark, d):
    return table(spark, d, "part").select("p_partkey", signals.acronym(F.col("p_name")).alias("acronym"))


_PATTERNS = ", ".join("regexp_extract_all(t, '{}', 1)".format(p.replace("'", "''")) for p in signals.DISTINCTIVE)


@q(f"""WITH s AS (SELECT doc_id, text || ' Use x_y.z at 1.5 on 2024-01-02, then `a b` NASA and (Rome).' AS t, left(text, length(text) // 2) AS r FROM documents), w AS (SELECT doc_id, t, r, list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '') AS w FROM s),
 b AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '^[.,;:!?()\\[\\]{{}}"''`]+|[.,;:!?()\\[\\]{{}}"''`]+$', '', 'g')) AS b FROM w), n AS (SELECT doc_id, t, r, list_filter(list_transform(b, lambda x, i: CASE WHEN (regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AND length(x) > 1)
 OR (i > 1 AND NOT regexp_matches(w[i - 1], '[.!?:]$') AND regexp_matches(x, '^\\p{{Lu}}') AND length(x) > 2) THEN x END), lambda x: x IS NOT NULL) AS names FROM b),
 d AS (SELECT doc_id, r, list_filter(list_sort(list_distinct(list_transform(flatten([{_PATTERNS}, names]), lambda x: trim(x)))), lambda x: x <> '') AS d FROM n) SELECT doc_id, array_to_string(list_filter(d, lambda x: NOT contains(r, x)), '|') AS dropped FROM d""")
def rewrite_dropped_tokens(spark, d):
    source = F.concat("text", F.lit(" Use x_y.z at 1.5 on 2024-01-02, then `a b` NASA and (Rome)."))
    kept = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.array_join(signals.dropped_tokens(source, kept), "|").alias("dropped"))


@q("SELECT p_partkey, CASE WHEN p_size > 45 THEN 'title' WHEN left(p_brand, 7) NOT IN ('Brand#1', 'Brand#2', 'Brand#4') THEN 'type' WHEN p_partkey % 5 = 0 THEN 'slug' WHEN p_retailprice / 1000 > 1 THEN 'confidence' WHEN len(string_split(p_name, ' ')) > 4 THEN 'tags' END AS reason FROM part")
def schema_gate(spark, d):
    slug = F.when(F.col("p_partkey") % 5 == 0, "Not A Slug").otherwise("a-slug")
    title = F.when(F.col("p_size") > 45, " ").otherwise(F.col("p_name"))
    kinds = ("Brand#1", "Brand#2", "Brand#4")
    reason = signals.schema_reason(title, F.col("p_name"), F.left("p_brand", F.lit(7)), kinds, slug, F.col("p_retailprice") / 1000, F.split("p_name", " "), 4)
    return table(spark, d, "part").select("p_partkey", reason.alias("reason"))


@q("WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, round(1 / (1 + exp(-n / 1000.0)), 9)::DOUBLE AS p, round(2 + 1.4 * sqrt(n), 9)::DOUBLE AS radius FROM g")
def rating_curves(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select("event_type", F.round(signals.sigmoid(F.col("n") / 1000.0), 9).alias("p"), F.round(signals.node_radius(F.col("n")), 9).alias("radius"))


@q("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(sha256(html), 1, 16) ELSE trim(url) END AS identity FROM pages")
def feed_identity(spark, d):
    url = F.when(F.col("page_id") % 3 != 0, F.col("url")).otherwise("")
    return table(spark, d, "pages").select("page_id", signals.candidate_identity(url, F.col("html")).alias("identity"))


@q(r"""SELECT doc_id, sha256('v3' || chr(10) || 'rules' || chr(10) || lower(array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)),
 lambda x: trim(regexp_replace(x, '[ \t\n\r\f\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(10)))) AS key, substr(trim('t' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || trim(text)), 1, 400) AS embed FROM documents""")
def enrichment_inputs(spark, d):
    t = F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", signals.enrichment_key(F.col("text"), "v3", "rules").alias("key"), signals.embed_text(t, F.col("text"), 400).alias("embed"))


@q(f"""WITH {_RAW}, b AS (SELECT rw.doc_id, rw.path, rw.status, lang FROM rw JOIN notes USING (doc_id)) SELECT path, CASE WHEN status = 'inbox' THEN 'new' WHEN status = 'unfiled' THEN 'gone' ELSE 'changed' END AS change,
 CASE WHEN status <> 'unfiled' THEN CAST(doc_id % 4 <> 3 AS INT) + CAST(doc_id % 10 = 3 AS INT) ELSE 0 END AS n_links FROM b WHERE status IN ('inbox', 'unfiled') OR lang = 'de'""")
def snapshot_rebuild(spark, d):
    """A corpus before and after: notes of one state come, of another go, those of one language are newer."""
    n = _raw(spark, d).join(notes(spark, d).select("doc_id", "captured", "lang"), "doc_id").select("path", "stem", F.col("captured").alias("modified"), "raw", "status", "lang")
    folder = scratch(spark)
    snapshots.rebuild(n.where("status <> 'inbox'").select("path", "stem", "modified", "raw"), folder)
    later = n.where("status <> 'unfiled'").withColumn("modified", F.when(F.col("lang") == "de", F.col("modified") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("modified")))
    done = snapshots.rebuild(later.select("path", "stem", "modified", "raw"), folder)
    return done.join(snapshots.read(spark, folder).select("path", F.size("links").alias("n_links")), "path")
