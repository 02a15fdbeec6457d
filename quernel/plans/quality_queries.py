"""Queries of retrieval quality, families of notes, contracts and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators import evaluate, families, lexical, lint
from quernel.plans.book import Book
from quernel.plans.search_queries import _ANY, _BM25, _queries, _top_sql
from quernel.sources.tables import MARKDOWN, NOTES, markdown, note_links, notes, table

BOOK = Book()
q = BOOK.query

_GOLD = """gold AS (SELECT item_id AS query_id, list(path) FILTER (path IS NOT NULL) AS expected FROM benchmark b LEFT JOIN notes n ON contains(n.body, b.text) GROUP BY 1),
 g AS (SELECT query_id, coalesce(expected, []) AS expected FROM gold)"""
_CARD = f"""WITH {_BM25}, {_GOLD}, rk AS ({_top_sql(_ANY, 5)}), h AS (SELECT g.query_id, any_value(expected) AS expected, count(rank) AS n, count(rank) FILTER (list_contains(expected, path)) AS hits, min(rank) FILTER (list_contains(expected, path)) AS first_rank FROM g LEFT JOIN rk USING (query_id) GROUP BY 1),
 sc AS (SELECT query_id, hits, len(expected) = 0 AS is_negative, CASE WHEN len(expected) = 0 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END ELSE hits / 5.0 END::DOUBLE AS p_at_k, CASE WHEN len(expected) = 0 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END ELSE hits / len(expected) END::DOUBLE AS r_at_k, coalesce(first_rank, -1) AS first_rank FROM h)"""


def _scores(spark, d):
    n = notes(spark, d)
    items = table(spark, d, "benchmark")
    inside = lexical.containing(n.select("path", "body"), items, "body", "path", "text", "item_id").groupBy(F.col("item_id").alias("query_id")).agg(F.collect_list("path").alias("expected"))
    gold = items.select(F.col("item_id").alias("query_id")).join(inside, "query_id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))
    ranked = lexical.top(lexical.match_any(n, _queries(spark, d)), 5).withColumnRenamed("path", "item")
    return evaluate.at_k(gold, ranked, 5)


@q(_CARD + " SELECT * FROM sc")
def eval_at_k(spark, d):
    return _scores(spark, d).withColumn("first_rank", F.coalesce("first_rank", F.lit(-1)).cast("long"))


@q(_CARD + " SELECT count(*) FILTER (NOT is_negative) AS scored, count(*) FILTER (NOT is_negative AND hits > 0) AS hit, avg((hits > 0)::INT) FILTER (NOT is_negative) AS r_at_k, avg(first_rank) FILTER (NOT is_negative AND first_rank > 0) AS mean_first_rank, avg(CASE WHEN first_rank > 0 THEN 1.0::DOUBLE / first_rank ELSE 0 END) FILTER (NOT is_negative) AS mrr, count(*) FILTER (is_negative AND p_at_k = 1) AS rejected FROM sc")
def eval_scorecard(spark, d):
    return evaluate.scorecard(_scores(spark, d))


@q("WITH r AS (SELECT doc_id AS query_id, quality = 1 AS b, toxic = 0 AS a FROM labels) SELECT count(*) FILTER (NOT b AND a) AS won, count(*) FILTER (b AND NOT a) AS lost, count(*) FILTER (a = b) AS same FROM r")
def eval_flips(spark, d):
    l = table(spark, d, "labels")
    return evaluate.flips(l.select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("hit")), l.select(F.col("doc_id").alias("query_id"), (F.col("toxic") == 0).alias("hit")))


@q("SELECT quality, count(*) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS sd, min(n_chars) AS least, max(n_chars) AS most FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def eval_arm_stats(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.stddev_samp("n_chars"), 4).alias("sd"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


_CHANGED = "ch AS (SELECT source, count(*) FILTER (quality = 0 AND toxic = 0) AS won, count(*) FILTER (quality = 1 AND toxic = 1) AS lost FROM labels JOIN documents USING (doc_id) GROUP BY 1)"


@q(f"""WITH {_CHANGED}, c AS (SELECT source, won, lost, unnest(range(least(won, lost) + 1)) AS i FROM ch), t AS (SELECT source, sum(factorial(CAST(won + lost AS INT))::DOUBLE / factorial(CAST(i AS INT))::DOUBLE / factorial(CAST(won + lost - i AS INT))::DOUBLE / pow(2, won + lost)) AS tail FROM c WHERE won + lost <= 30 GROUP BY 1)
 SELECT source, won, lost, round(CASE WHEN won + lost = 0 THEN 1.0::DOUBLE WHEN won + lost <= 30 THEN least(1.0::DOUBLE, 2 * tail) END, 9) AS p FROM ch LEFT JOIN t USING (source)""")
def eval_mcnemar(spark, d):
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    c = l.groupBy("source").agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("won"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("lost"))
    return c.select("source", "won", "lost", F.round(F.when(F.col("won") + F.col("lost") <= 30, evaluate.mcnemar_p(F.col("won"), F.col("lost"))), 9).alias("p"))


_RUNS = "ru AS (SELECT lang, doc_id % 5 AS run, quality = 1 AS good, avg(n_chars) AS v FROM labels JOIN documents USING (doc_id) GROUP BY ALL)"
_DEALT = "m AS (SELECT *, unnest(range(CAST(pow(2, len(pool)) AS BIGINT))) AS mask FROM p), s AS (SELECT *, bit_count(mask) AS many, list_sum(list_transform(pool, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN x ELSE 0 END)) AS c FROM m)"


@q(f"""WITH {_RUNS}, p AS (SELECT lang, list_concat(list(v) FILTER (good), list(v) FILTER (NOT good)) AS pool, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS m, sum(v) FILTER (good) AS own, sum(v) AS total FROM ru GROUP BY 1), {_DEALT}
, t AS (SELECT lang, round(avg((abs(c / n - (total - c) / m) >= abs(own / n - (total - own) / m) - 1e-9)::INT), 9) AS p FROM s WHERE many = n AND n > 0 AND m > 0 GROUP BY 1) SELECT lang, p FROM (SELECT DISTINCT lang FROM ru) LEFT JOIN t USING (lang)""")
def eval_permutation(spark, d):
    runs = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("lang", (F.col("doc_id") % 5).alias("run"), (F.col("quality") == 1).alias("good")).agg(F.avg("n_chars").alias("v"))
    return evaluate.permutation_tests(runs, "lang", "good", "v").select("lang", F.round("p", 9).alias("p"))


@q(f"""WITH {_RUNS}, df AS (SELECT lang, run, max(v) FILTER (good) - max(v) FILTER (NOT good) AS x FROM ru GROUP BY 1, 2), p AS (SELECT lang, list(x) FILTER (x IS NOT NULL) AS pool, sum(x) AS total FROM df GROUP BY 1), {_DEALT}
, t AS (SELECT lang, round(avg((abs(total - 2 * c) >= abs(total) - 1e-9)::INT), 9) AS p FROM s WHERE len(pool) > 0 GROUP BY 1) SELECT lang, p FROM (SELECT DISTINCT lang FROM ru) LEFT JOIN t USING (lang)""")
def eval_sign_flip(spark, d):
    runs = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("lang", (F.col("doc_id") % 5).alias("run")).agg(
        (F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))) - F.avg(F.when(F.col("quality") != 1, F.col("n_chars")))).alias("x"))
    return evaluate.sign_flip_tests(runs, "lang", "x").select("lang", F.round("p", 9).alias("p"))


_FP = r"sha256(lower(array_to_string(list_filter(list_transform(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\n\r\f\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(10))))"


@q(f"WITH {NOTES}, f AS (SELECT path, updated, {_FP} AS fingerprint FROM notes), r AS (SELECT *, count(*) OVER (PARTITION BY fingerprint) AS size, row_number() OVER (PARTITION BY fingerprint ORDER BY updated IS NULL, updated, path) AS k FROM f) SELECT fingerprint, size, path AS canonical FROM r WHERE k = 1 AND size >= 2")
def family_exact(spark, d):
    return families.exact_families(notes(spark, d), "body", "path", "updated")


@q(f"WITH {NOTES} SELECT title, count(*) AS n, count(DISTINCT {_FP}) AS bodies FROM notes GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT {_FP}) > 1")
def family_contradictions(spark, d):
    return families.contradictions(notes(spark, d), "title", "body")


@q()
def family_like_groups(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("note"), "text")
    return families.like_groups(turns, "text", "note")


@q("""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}')) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM benchmark),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) BETWEEN 2 AND (SELECT floor(0.5 * n) FROM n)), w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term) CROSS JOIN n),
 l AS (SELECT item_id, sqrt(sum(w * w)) AS len FROM w GROUP BY 1), u AS (SELECT item_id, term, w / len AS w FROM w JOIN l USING (item_id))
 SELECT x.item_id AS a, y.item_id AS b, round(sum(x.w * y.w), 6) AS score FROM u x JOIN u y ON x.term = y.term AND x.item_id < y.item_id GROUP BY 1, 2 HAVING sum(x.w * y.w) >= 0.18""")
def tfidf_pairs(spark, d):
    return families.tfidf_pairs(table(spark, d, "benchmark"), "text", "item_id", 0.18).withColumn("score", F.round("score", 6))


@q()
def lexical_snippets(spark, d):
    n = notes(spark, d)
    hits = lexical.top(lexical.match_any(n, _queries(spark, d)), 5)
    terms = _queries(spark, d).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    # The bodies join back after the cut, so only survivors carry text.
    return families.snippets(hits.join(n.select("path", "body"), "path").join(terms, "query_id"), "body", "terms").drop("body", "terms")


@q()
def chunk_paragraphs(spark, d):
    return families.chunks(table(spark, d, "documents"), "text", "doc_id")


@q()
def chunk_headings(spark, d):
    return families.header_chunks(markdown(spark, d).withColumn("raw", X.body(F.col("raw"))), "raw", "doc_id")


_CHECKS = f"""WITH {NOTES}, {MARKDOWN}, h AS (SELECT n.*, regexp_extract(raw, '(?m)^kind: (.+)$', 1) AS kind, length(raw) AS size FROM notes n JOIN md USING (doc_id))"""


@q(_CHECKS + """, f AS (SELECT path, unnest([CASE WHEN confidence IS NULL THEN 'missing confidence' END, CASE WHEN updated < captured THEN 'updated before captured' END, CASE WHEN NOT regexp_matches(source, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'source is not kebab' END,
 CASE WHEN contains(title, '|') THEN 'placeholder' END, CASE WHEN length(title) < 20 THEN 'short title' END]) AS finding FROM h) SELECT path, finding FROM f WHERE finding IS NOT NULL""")
def lint_findings(spark, d):
    c = F.col
    checks = {
        "missing confidence": c("confidence").isNull(), "updated before captured": c("updated") < c("captured"), "source is not kebab": ~lint.kebab(c("source")),
        "placeholder": c("title").contains("|"), "short title": F.length("title") < 20,
    }
    return lint.findings(notes(spark, d), "path", checks)


@q(f"""WITH {NOTES} SELECT path, coalesce(CASE WHEN list_contains(flags, 'space') THEN 'space' END, CASE WHEN status = 'superseded' THEN 'status' END, CASE WHEN octet_length(encode(body)) > 8192 THEN 'size' END, CASE WHEN confidence < 0.2 THEN 'confidence' END, 'eligible') AS reason FROM notes""")
def gate_reasons(spark, d):
    c = F.col
    gates = {"space": F.array_contains("flags", "space"), "status": c("status") == "superseded", "size": F.octet_length("body") > 8192, "confidence": c("confidence") < 0.2}
    return notes(spark, d).select("path", F.coalesce(lint.first_reason(gates), F.lit("eligible")).alias("reason"))


@q(f"WITH {NOTES} SELECT path FROM notes WHERE status = 'active' AND contains(meta, 'src3') AND (path = 'src3' OR starts_with(path, 'src3/') OR starts_with(path, 'src13/en/'))")
def filter_language(spark, d):
    where = lint.matches(lint.parse_filter("status=active AND tag=src3"), {"status": "status", "tag": "meta"})
    return notes(spark, d).where(where & lint.in_scope(F.col("path"), ["src3", "src13/en"])).select("path")


_KNOWN_KEYS = ("title", "status", "supersedes", "tags", "kind", "captured")
_KEY_LIST = "[" + ", ".join(f"'{k}'" for k in _KNOWN_KEYS) + "]"


@q(f"""WITH {NOTES}, {MARKDOWN}, k AS (SELECT doc_id, stem, lang, source, regexp_extract_all(regexp_extract(raw, '(?s)\\A---\\n(.*?)\\n---\\n', 1), '(?m)^([A-Za-z_]+):', 1) AS keys, lower(replace(regexp_extract(raw, '(?m)^title: "(.*)"$', 1), 'Note ', 'n')) AS slug FROM notes JOIN md USING (doc_id, stem)),
 f AS (SELECT doc_id, CASE WHEN list_filter(keys, lambda x: list_contains({_KEY_LIST}, x)) <> list_filter({_KEY_LIST}, lambda x: list_contains(keys, x)) THEN ['fields out of order'] ELSE [] END || list_transform(list_filter(keys, lambda x: NOT list_contains({_KEY_LIST}, x)), lambda x: 'unknown key ' || x)
 || CASE WHEN slug <> stem || CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE '' END THEN ['slug is not the file name'] ELSE [] END || CASE WHEN source || CASE WHEN lang = 'de' THEN '_' ELSE '' END NOT SIMILAR TO '[a-z0-9]+(-[a-z0-9]+)*' THEN ['arc is not kebab'] WHEN source NOT IN ('src0', 'src1', 'src2') THEN ['arc is unknown'] ELSE [] END AS f FROM k) SELECT doc_id, unnest(f) AS finding FROM f""")
def lint_schema(spark, d):
    m = markdown(spark, d).join(notes(spark, d).select("doc_id", "lang", "source"), "doc_id")
    front = X.head(F.col("raw"))
    slug = F.lower(F.replace(X.field(front, "title"), F.lit("Note "), F.lit("n")))
    name = F.concat("stem", F.when(F.col("doc_id") % 6 == 0, "x").otherwise(""))
    arc = F.concat("source", F.when(F.col("lang") == "de", "_").otherwise(""))
    return m.select("doc_id", F.explode(lint.schema_findings(front, _KNOWN_KEYS, slug, name, arc, ("src0", "src1", "src2"))).alias("finding"))


@q("SELECT event_type, count(*) AS n, CASE WHEN event_type IN ('view', 'click') THEN 'known' WHEN event_type = 'error' THEN 'retired' ELSE 'unrecognised' END AS label FROM events GROUP BY 1")
def lint_taxonomy(spark, d):
    return lint.taxonomy(table(spark, d, "events"), "event_type", ["view", "click"], ["error"])


@q(f"""WITH {NOTES} SELECT path, round(0.4 * greatest(0, 1 - 0.2 * ((confidence IS NULL)::INT + (updated IS NULL)::INT)) + 0.3 * (doc_id % 40 <> 0)::INT + 0.3 * pow(0.5, greatest(0, date_diff('day', captured, TIMESTAMP '2024-06-01')) / 30.0), 6)::DOUBLE AS score FROM notes""")
def note_quality_score(spark, d):
    complete = F.greatest(F.lit(0.0), 1 - 0.2 * (F.col("confidence").isNull().cast("int") + F.col("updated").isNull().cast("int")))
    fresh = X.decay_exponential(F.datediff(F.lit("2024-06-01").cast("date"), "captured"))
    score = 0.4 * complete + 0.3 * (F.col("doc_id") % 40 != 0).cast("int") + 0.3 * fresh
    return notes(spark, d).select("path", F.round(score, 6).alias("score"))


@q("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, sum(length(text))::BIGINT AS chars, string_agg(role, '>' ORDER BY turn) AS shape FROM conversations GROUP BY 1")
def transcript_shapes(spark, d):
    order = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"), F.array_join(order, ">").alias("shape")
    )


@q(f"WITH {NOTES}, k AS (SELECT path FROM notes WHERE doc_id % 3 = 0), s AS (SELECT path FROM notes WHERE doc_id % 2 = 0) SELECT path, 'removed' AS side FROM k WHERE path NOT IN (SELECT path FROM s) UNION ALL SELECT path, 'unseen' FROM s WHERE path NOT IN (SELECT path FROM k)")
def set_differences(spark, d):
    n = notes(spark, d)
    known, seen = n.where("doc_id % 3 = 0").select("path"), n.where("doc_id % 2 = 0").select("path")
    return known.exceptAll(seen).withColumn("side", F.lit("removed")).unionByName(seen.join(known, "path", "left_anti").withColumn("side", F.lit("unseen")))


@q(f"WITH {NOTES}, g AS (SELECT source, list(stem ORDER BY captured DESC, stem) AS stems FROM notes WHERE status = 'active' GROUP BY 1) SELECT source, array_to_string(list_slice(stems, 1, 10), '|') AS newest, len(stems) AS n FROM g")
def contents_by_source(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.col("captured").desc(), "stem")
    live = notes(spark, d).where("status = 'active'").withColumn("k", F.row_number().over(order))
    newest = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("k", "stem")))), lambda x: x["stem"])
    return live.groupBy("source").agg(F.array_join(newest, "|").alias("newest"), F.count("*").alias("n"))


@q(f"WITH {NOTES}, p AS (SELECT path, CASE WHEN status = 'superseded' THEN regexp_replace(body, '^', 'status: superseded' || chr(10)) ELSE body END AS body FROM notes) SELECT path, sha256(body) AS hash FROM p")
def supersession_rewrite(spark, d):
    new = F.when(F.col("status") == "superseded", F.concat(F.lit("status: superseded\n"), "body")).otherwise(F.col("body"))
    return notes(spark, d).select("path", F.sha2(new, 256).alias("hash"))


@q("WITH v AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 2 END AS ver FROM embeddings) SELECT count(*) AS in_scope, count(*) FILTER (vec_id IS NOT NULL AND ver = 2) AS current, count(*) FILTER (ver = 1) AS stale, count(*) FILTER (vec_id IS NULL) AS pending FROM documents LEFT JOIN v ON doc_id = vec_id")
def vector_coverage(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 == 0, 1).otherwise(2).alias("ver"))
    j = table(spark, d, "documents").select("doc_id").join(v, F.col("doc_id") == F.col("vec_id"), "left")
    return j.agg(F.count("*").alias("in_scope"), F.count_if(F.col("ver") == 2).alias("current"), F.count_if(F.col("ver") == 1).alias("stale"), F.count_if(F.col("vec_id").isNull()).alias("pending"))


@q("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_pending(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
