"""Queries of a corpus' upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import graph, upkeep
from quernel.plans.book import Book
from quernel.plans.graph_queries import _L, _resolved
from quernel.sources.tables import notes, table

BOOK = Book()
q = BOOK.query

#: Every third body has an old footer.
_OLD = f"{upkeep.BEGIN}\n\nold\n\n{upkeep.END}"
_BODY = f"CASE WHEN doc_id % 3 = 0 THEN body || chr(10) || '{upkeep.BEGIN}' || chr(10) || chr(10) || 'old' || chr(10) || chr(10) || '{upkeep.END}' || ' after' ELSE body || chr(10) || chr(10) END"


@q(_L + f""", nb AS (SELECT path, {_BODY} AS body, doc_id % 3 = 0 AS has FROM notes), bl AS (SELECT t AS path, '{upkeep.BEGIN}' || chr(10) || chr(10) || '**Referenced by:**' || chr(10) || chr(10) || string_agg('- [[' || s || ']]', chr(10) ORDER BY s) || chr(10) || chr(10) || '{upkeep.END}' AS footer FROM ed GROUP BY 1),
 nw AS (SELECT path, body, CASE WHEN footer IS NOT NULL AND has THEN replace(body, '{upkeep.BEGIN}' || chr(10) || chr(10) || 'old' || chr(10) || chr(10) || '{upkeep.END}', footer) WHEN footer IS NOT NULL THEN rtrim(body, chr(10)) || chr(10) || chr(10) || footer || chr(10)
 WHEN has THEN rtrim(replace(body, '{upkeep.BEGIN}' || chr(10) || chr(10) || 'old' || chr(10) || chr(10) || '{upkeep.END}', ''), chr(10)) || chr(10) ELSE body END AS new FROM nb LEFT JOIN bl USING (path)) SELECT path, sha256(new) AS hash FROM nw WHERE new <> body""")
def upkeep_footers(spark, d):
    body = F.when(F.col("doc_id") % 3 == 0, F.concat("body", F.lit(f"\n{_OLD} after"))).otherwise(F.concat("body", F.lit("\n\n")))
    n = notes(spark, d).select("path", body.alias("body"))
    return upkeep.backlink_footers(n, graph.edges(_resolved(spark, d))).select("path", F.sha2("body", 256).alias("hash"))


@q(_L + ", dg_ AS (SELECT target, count(DISTINCT source_path) AS n FROM rs WHERE resolved IS NULL GROUP BY 1) SELECT 'stub-synthesis' AS owner, target, n || ' notes link to it and nothing answers' AS reason FROM dg_ WHERE n >= 2")
def upkeep_stubs(spark, d):
    return upkeep.stub_requests(graph.dangling(_resolved(spark, d)))


@q(f"""WITH p AS (SELECT item_id, doc_id, q.text AS question, d.text AS text FROM benchmark q JOIN documents d ON d.doc_id = q.item_id), f AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) GROUP BY 1),
 n AS (SELECT count(*) AS n FROM documents), t AS (SELECT item_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), lambda t: length(t) > 2)) AS term FROM p), w AS (SELECT item_id, term, ln(1 + n / (1 + coalesce(df, 0))) AS w FROM t LEFT JOIN f USING (term) CROSS JOIN n),
 b AS (SELECT item_id, substr(text, {upkeep.HEAD + 1}, length(text) - {upkeep.HEAD + upkeep.TAIL}) AS b FROM p WHERE length(text) > {upkeep.WHOLE}), s AS (SELECT item_id, b, unnest(range(0, greatest(length(b) - {upkeep.MIDDLE}, 1), {upkeep.MIDDLE // 2})) AS pos FROM b),
 c AS (SELECT item_id, pos, substr(b, pos + 1, {upkeep.MIDDLE}) AS piece, regexp_extract_all(lower(substr(b, pos + 1, {upkeep.MIDDLE})), '[a-z0-9]+') AS ws FROM s),
 k AS (SELECT item_id, pos, piece, round(sum(coalesce(w, 0) * least(3, len(list_filter(ws, lambda x: x = term)))), 9) AS score FROM c LEFT JOIN w USING (item_id) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS k FROM k),
 m AS (SELECT item_id, string_agg(piece, chr(10) || '[...]' || chr(10) ORDER BY k) AS mids FROM r WHERE k <= {upkeep.MIDDLES} GROUP BY 1)
 SELECT item_id, sha256(CASE WHEN mids IS NULL THEN text ELSE left(text, {upkeep.HEAD}) || chr(10) || '[...]' || chr(10) || mids || chr(10) || '[...]' || chr(10) || right(text, {upkeep.TAIL}) END) AS hash FROM p LEFT JOIN m USING (item_id)""")
def answer_excerpts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    pairs = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")).join(docs, F.col("item_id") == F.col("doc_id"))
    df, n = upkeep.document_frequencies(docs, "text")
    return upkeep.answer_excerpts(pairs, "question", "text", df, n, "item_id").select("item_id", F.sha2("excerpt", 256).alias("hash"))


@q("""WITH m AS (SELECT CAST(ts AS DATE) AS cycle, event_id, event_type, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS k FROM events)
 SELECT strftime(cycle, '%Y-%m-%d') AS cycle, count(*) AS sampled, count(*) FILTER (event_type IN ('view', 'click', 'purchase', 'signup')) AS agreed, round(1 - count(*) FILTER (event_type IN ('view', 'click', 'purchase', 'signup')) / count(*), 9) AS rate, 1 - count(*) FILTER (event_type IN ('view', 'click', 'purchase', 'signup')) / count(*) > 0.2 AS alarming FROM m WHERE k <= 25 GROUP BY 1""")
def sampled_audits(spark, d):
    verdict = F.when(F.col("event_type") != "error", "agree")
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("cycle"), "event_id", verdict.alias("verdict"))
    return upkeep.sampled_audits(e, "cycle", "event_id", "verdict").withColumn("rate", F.round("rate", 9))


@q("""WITH s AS (SELECT p_partkey, list_slice(string_split(CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN p_name || ' ' || split_part(p_name, ' ', 1) ELSE p_name END, ' '), 1, p_size % 8) AS s FROM part),
 u AS (SELECT p_partkey, unnest(s) AS x, generate_subscripts(s, 1) AS i, s FROM s), w AS (SELECT p_partkey, i, CASE WHEN trim(x) = '' THEN 'no slug at ' || (i - 1) WHEN NOT regexp_matches(x, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'bad slug at ' || (i - 1) WHEN list_position(s, x) < i THEN 'repeated slug at ' || (i - 1) END AS r FROM u),
 f AS (SELECT p_partkey, arg_min(r, i) FILTER (r IS NOT NULL) AS r FROM w GROUP BY 1) SELECT p_partkey, CASE WHEN len(s) < 2 THEN 'no split' WHEN len(s) > 6 THEN 'a list' ELSE r END AS reason FROM s LEFT JOIN f USING (p_partkey)""")
def split_plans(spark, d):
    name, i = F.col("p_name"), F.col("p_partkey") % 4
    words = F.split(F.when(i == 0, F.upper(name)).when(i == 1, F.concat(name, F.lit(" "), F.split(name, " ")[0])).otherwise(name), " ")
    slugs = F.when(F.col("p_size") % 8 == 0, F.array().cast("array<string>")).otherwise(F.slice(words, F.lit(1), (F.col("p_size") % 8).cast("int")))
    return table(spark, d, "part").select("p_partkey", upkeep.split_reason(slugs).alias("reason"))


@q("""WITH s AS (SELECT o_orderpriority AS stratum, o_orderstatus = 'P' OR o_orderkey % 11 = 0 AS is_negative, o_totalprice > 150000 AS hit, o_orderkey % 3 AS returned, o_orderkey % 22 = 0 AS gate_only, o_custkey % 13 = 0 AS excluded FROM orders),
 b AS (SELECT stratum, CASE WHEN is_negative AND gate_only THEN 'gate-only' WHEN is_negative THEN 'rejection' WHEN excluded THEN 'excluded' ELSE 'recall' END AS block, CASE WHEN is_negative THEN returned = 0 ELSE hit END AS r FROM s)
 SELECT stratum, block, count(*) AS n, count(*) FILTER (r) AS right_, round(count(*) FILTER (r) / count(*), 9) AS rate FROM b GROUP BY 1, 2""")
def stratum_scores(spark, d):
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("stratum"), ((F.col("o_orderstatus") == "P") | (k % 11 == 0)).alias("is_negative"), (F.col("o_totalprice") > 150000).alias("hit"),
        (k % 3).alias("returned"), (k % 22 == 0).alias("gate_only"), (F.col("o_custkey") % 13 == 0).alias("excluded"))
    return upkeep.stratum_scores(s).withColumnRenamed("right", "right_").withColumn("rate", F.round("rate", 9))
