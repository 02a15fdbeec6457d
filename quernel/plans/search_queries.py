"""Queries of ranked retrieval: the benchmark's items as questions over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators import dense, fusion, lexical, recall
from quernel.plans.book import Book
from quernel.plans.text_queries import STEM_SQL, STOP_SQL, TOKENS_SQL
from quernel.sources.tables import NOTES, notes, table

BOOK = Book()
q = BOOK.query

#: Questions, their terms, the weighted postings and BM25 of each match, in SQL.
_TERMS = f"""qt AS (SELECT item_id, {TOKENS_SQL.format(c='text')} AS w FROM benchmark),
 qu AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM qt),
 qf AS (SELECT item_id, t, min(i) AS i FROM qu WHERE t NOT IN {STOP_SQL} GROUP BY 1, 2),
 qr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM qf),
 queries AS (SELECT item_id AS query_id, t AS term FROM qr WHERE k <= 6)"""
_BM25 = f"""{NOTES}, {_TERMS},
 tok AS (SELECT path, {TOKENS_SQL.format(c='title')} AS a, {TOKENS_SQL.format(c='meta')} AS b, {TOKENS_SQL.format(c='body')} AS c FROM notes),
 dl AS (SELECT path, len(a) + len(b) + len(c) AS len FROM tok), st AS (SELECT count(*) AS n, avg(len) AS avg FROM dl),
 ex AS (SELECT path, unnest(a) AS term, 4.0::DOUBLE AS w FROM tok UNION ALL SELECT path, unnest(b), 3.0::DOUBLE FROM tok UNION ALL SELECT path, unnest(c), 1.0::DOUBLE FROM tok),
 po AS (SELECT path, term, sum(w) AS tf FROM ex WHERE term IN (SELECT term FROM queries) GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
 ts AS (SELECT query_id, path, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
   * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg)) AS s FROM po JOIN df USING (term) JOIN queries USING (term) JOIN dl USING (path) CROSS JOIN st)"""


def _top_sql(body: str, k: int, key: str = "path", digits: int = 9) -> str:
    return f"SELECT * FROM (SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM (SELECT query_id, {key}, round(score, {digits}) AS score FROM ({body}))) WHERE rank <= {k}"


def _queries(spark, d):
    return lexical.query_batch(table(spark, d, "benchmark"), "item_id", "text")


_ANY = "SELECT query_id, path, sum(s) AS score FROM ts GROUP BY 1, 2"


@q(f"WITH {_BM25} " + _top_sql(_ANY, 10))
def lexical_bm25(spark, d):
    return lexical.top(lexical.match_any(notes(spark, d), _queries(spark, d)), 10)


@q(f"WITH {_BM25} " + _top_sql("SELECT query_id, path, sum(s) AS score FROM ts GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM queries z WHERE z.query_id = ts.query_id)", 10))
def lexical_and(spark, d):
    return lexical.top(lexical.match_all(notes(spark, d), _queries(spark, d)), 10)


@q(f"WITH {_BM25}, pr AS (SELECT x.query_id, x.path, max(x.s + y.s) AS score FROM ts x JOIN ts y ON x.query_id = y.query_id AND x.path = y.path AND x.term < y.term GROUP BY 1, 2) " + _top_sql("SELECT * FROM pr", 10))
def lexical_fusion_pairs(spark, d):
    return lexical.top(lexical.subset_fusion(notes(spark, d), _queries(spark, d)), 10)


@q(f"WITH {_BM25}, pr AS (SELECT x.query_id, x.path, x.s + y.s AS score, 2 AS n FROM ts x JOIN ts y ON x.query_id = y.query_id AND x.path = y.path AND x.term < y.term UNION ALL SELECT x.query_id, x.path, x.s + y.s + z.s, 3 FROM ts x JOIN ts y ON x.query_id = y.query_id AND x.path = y.path AND x.term < y.term JOIN ts z ON x.query_id = z.query_id AND x.path = z.path AND y.term < z.term) "
   + _top_sql("SELECT query_id, path, max(score) AS score FROM pr GROUP BY 1, 2", 10))
def lexical_fusion_triples(spark, d):
    return lexical.top(lexical.subset_fusion(notes(spark, d), _queries(spark, d), terms=3), 10)


_MULT = """CASE WHEN list_contains(flags, 'space') THEN 0.3 ELSE 1 END * CASE WHEN list_contains(flags, 'fragment') THEN 0.3 ELSE 1 END
 * CASE WHEN list_contains(flags, 'artifact') THEN 0.3 ELSE 1 END * CASE WHEN list_contains(flags, 'status') THEN 0.6 ELSE 1 END"""
_AGE = "date_diff('day', coalesce(updated, CASE WHEN captured_src = 'frontmatter' THEN captured END), TIMESTAMP '2026-01-01')"
_DECAY = f"CASE WHEN list_contains(flags, 'durable') OR {_AGE} IS NULL THEN 1 WHEN {_AGE} <= 182 THEN 1 WHEN {_AGE} <= 365 THEN 0.5 WHEN {_AGE} <= 1095 THEN 0.125 ELSE 0.0625 END"


@q(f"WITH {_BM25}, an AS ({_ANY}) " + _top_sql(f"SELECT query_id, path, score * ({_MULT})::DOUBLE * ({_DECAY})::DOUBLE AS score FROM an JOIN notes USING (path)", 10))
def lexical_penalised(spark, d):
    n = notes(spark, d)
    scored = lexical.penalise(lexical.match_any(n, _queries(spark, d)), n, now="2026-01-01")
    return lexical.top(scored.select("query_id", "path", "score"), 10)


@q(f"WITH {_BM25}, an AS ({_ANY}) " + _top_sql("SELECT query_id, path, score FROM an JOIN notes USING (path) WHERE captured >= TIMESTAMP '2023-06-01' AND captured < TIMESTAMP '2024-03-01' AND status <> 'superseded'", 5))
def lexical_dated(spark, d):
    n = notes(spark, d)
    inside = n.where((F.col("captured") >= "2023-06-01") & (F.col("captured") < "2024-03-01") & (F.col("status") != "superseded")).select("path")
    return lexical.top(lexical.match_any(n, _queries(spark, d)).join(inside, "path", "left_semi"), 5)


_MATCHED = f"""WITH {_TERMS}, sq AS (SELECT query_id, {STEM_SQL.replace('t LIKE', 'term LIKE').replace('(t)', '(term)').replace('(t,', '(term,').replace('ELSE t ', 'ELSE term ')} AS term, count(*) AS times FROM queries GROUP BY 1, 2),
 w AS (SELECT doc_id, unnest({TOKENS_SQL.format(c='text')}) AS t FROM documents), sw AS (SELECT doc_id, {STEM_SQL} AS term FROM w),
 dl AS (SELECT doc_id, count(*) AS len FROM sw GROUP BY 1), tf AS (SELECT doc_id, term, count(*) AS tf FROM sw WHERE term IN (SELECT term FROM sq) GROUP BY 1, 2),
 h AS (SELECT query_id, doc_id, term, times, tf, len FROM tf JOIN sq USING (term) JOIN dl USING (doc_id)),
 m AS (SELECT query_id, count(*) AS n, avg(len) AS avg FROM (SELECT DISTINCT query_id, doc_id, len FROM h) GROUP BY 1),
 df AS (SELECT query_id, term, count(*) AS df FROM h GROUP BY 1, 2),
 s AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg)) * times) AS score FROM h JOIN m USING (query_id) JOIN df USING (query_id, term) GROUP BY 1, 2) """


@q(_MATCHED + _top_sql("SELECT * FROM s", 10, "doc_id"))
def lexical_matched_idf(spark, d):
    return lexical.top(lexical.matched_idf(table(spark, d, "documents"), _queries(spark, d), best=10), 10, "doc_id")


@q(f"""WITH {NOTES}, k AS (SELECT item_id AS query_id, {TOKENS_SQL.format(c='text')} AS w FROM benchmark),
 s AS (SELECT query_id, path, len(list_filter(w, lambda t: contains(lower(stem || ' ' || meta || ' ' || substr(body, 1, 500)), t))) AS score FROM notes CROSS JOIN k WHERE status <> 'superseded') """
   + _top_sql("SELECT * FROM s WHERE score > 0", 5).replace("round(score, 9)", "score"))
def lexical_keyword_count(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.tokens(F.col("text")).alias("tokens"))
    live = notes(spark, d).where("status <> 'superseded'")
    return lexical.top(lexical.keyword_count(live, asked, F.concat_ws(" ", "stem", "meta"), "body", "path", best=5), 5)


@q("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), p AS (SELECT item_id AS query_id, list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 4) AS t FROM benchmark),
 r AS (SELECT doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS run FROM w WHERE len(w) > 0)
 SELECT query_id, doc_id, count(*) AS n FROM r JOIN p ON run = array_to_string(t, ' ') GROUP BY 1, 2""")
def lexical_phrase(spark, d):
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(X.tokens(F.col("text"), 1), 1, 4).alias("tokens"))
    return lexical.phrase_matches(table(spark, d, "documents"), phrases)


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@q("SELECT query_id, vec_id, score, rank FROM (" + _top_sql(f"SELECT b.vec_id AS query_id, a.vec_id AS vec_id, {_COS} AS score FROM embeddings a CROSS JOIN embeddings b WHERE b.vec_id % 50 = 0", 10, "vec_id", 6) + ")")
def vector_search(spark, d):
    e = table(spark, d, "embeddings")
    return dense.vector_search(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@q(_top_sql(f"SELECT b.vec_id AS query_id, a.vec_id // 3 AS note_id, max({_COS}) AS score FROM embeddings a CROSS JOIN embeddings b WHERE b.vec_id % 50 = 0 GROUP BY 1, 2", 10, "note_id", 6))
def vector_best_chunk(spark, d):
    e = table(spark, d, "embeddings")
    chunks = e.select(F.floor(F.col("vec_id") / 3).alias("note_id"), "embedding")
    return dense.vector_search(chunks, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10, "note_id")


@q(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.35")
def vector_similar_pairs(spark, d):
    return dense.similar_pairs(table(spark, d, "embeddings"), 0.35).select("a", "b", F.round("score", 6).alias("score"))


_MOVED = "list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i % 3 = vec_id % 3 + 1 THEN 0.2 ELSE 0 END)"
_SET = f"v AS (SELECT vec_id, vec_id % 20 AS grp, embedding::DOUBLE[] AS s, {_MOVED} AS r FROM embeddings)"


@q(f"""WITH {_SET}, p AS (SELECT a.grp, avg(list_cosine_similarity(a.s, b.s)) AS source_convergence, avg(list_cosine_similarity(a.r, b.r)) AS rewrite_convergence FROM v a JOIN v b ON a.grp = b.grp AND a.vec_id < b.vec_id GROUP BY 1),
 f AS (SELECT grp, count(*) AS n, avg(list_cosine_similarity(s, r)) AS mean_fidelity, min(list_cosine_similarity(s, r)) AS min_fidelity, count(*) FILTER (list_cosine_similarity(s, r) < {dense.FIDELITY_FLOOR}) AS below_floor FROM v GROUP BY 1)
 SELECT grp, n, round(source_convergence, 9) AS source_convergence, round(rewrite_convergence, 9) AS rewrite_convergence, rewrite_convergence - source_convergence > {dense.CONVERGENCE_CEILING} AS homogenised, round(mean_fidelity, 9) AS mean_fidelity, round(min_fidelity, 9) AS min_fidelity, below_floor FROM f JOIN p USING (grp)""")
def vector_dispersion(spark, d):
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when((i + 1) % 3 == F.col("vec_id") % 3 + 1, 0.2).otherwise(0.0))
    pairs = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("grp"), F.col("embedding").cast("array<double>").alias("s"), moved.alias("r"))
    found = dense.rewrite_dispersion(pairs, "grp", "vec_id", "s", "r")
    near = (F.round(c, 9).alias(c) for c in ("source_convergence", "rewrite_convergence", "mean_fidelity", "min_fidelity"))
    return found.select("grp", "n", "homogenised", "below_floor", *near)


_HYBRID = f"""{_BM25}, lx AS ({_top_sql("SELECT query_id, doc_id, score FROM (" + _ANY + ") JOIN notes USING (path)", 50, "doc_id")}),
 dn AS ({_top_sql(f"SELECT b.vec_id AS query_id, a.vec_id AS doc_id, {_COS} AS score FROM embeddings a CROSS JOIN embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark)", 50, "doc_id", 6)}),
 un AS (SELECT query_id, doc_id, rank FROM lx UNION ALL SELECT query_id, doc_id, rank FROM dn), fu AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM un GROUP BY 1, 2)"""


@q(f"WITH {_HYBRID} " + _top_sql("SELECT * FROM fu", 20, "doc_id"))
def hybrid_rrf(spark, d):
    n = notes(spark, d)
    words = lexical.top(lexical.match_any(n, _queries(spark, d)).join(n.select("path", "doc_id"), "path").drop("path"), 50, "doc_id")
    e = table(spark, d, "embeddings")
    asked = e.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    vectors = dense.vector_search(e.withColumnRenamed("vec_id", "doc_id"), asked.withColumnRenamed("vec_id", "query_id"), 50, "doc_id")
    return lexical.top(fusion.rrf(words, vectors, key="doc_id"), 20, "doc_id")


_OLD = "CASE WHEN list_contains(flags, 'durable') THEN 1.0 ELSE pow(0.5, greatest(0, date_diff('day', CAST(captured AS DATE), DATE '2024-06-01')) / 30.0) END"
_RECALLED = f"""WITH {NOTES}, live AS (SELECT path AS doc_id, body AS text, {_OLD} AS decay FROM notes WHERE status = 'active' AND split_part(path, '/', 1) NOT IN ('_inbox', '_archive')),
 {_MATCHED[5:].replace("FROM documents", "FROM live")}, loaded AS (SELECT path FROM notes WHERE lang = 'es'),
 r AS (SELECT query_id, doc_id AS path, score AS keyword, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)) AS fused FROM s
 UNION ALL SELECT -1, doc_id, 0, 0 FROM (SELECT doc_id FROM live WHERE doc_id NOT IN (FROM loaded) ORDER BY doc_id LIMIT 5)),
 c AS (SELECT query_id, path, round(keyword, 9) AS keyword, round(fused * decay, 12) AS score FROM r JOIN live ON path = doc_id WHERE path NOT IN (FROM loaded))
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM c) WHERE rank <= 5"""


@q(_RECALLED)
def recall_filtered(spark, d):
    """Questions and one of unknown words, over active notes; those of one language are loaded already."""
    n = notes(spark, d)
    asked = _queries(spark, d).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit("zzqxzzq").alias("term")))
    decay = F.when(F.array_contains("flags", "durable"), 1.0).otherwise(X.decay_exponential(F.datediff(F.lit("2024-06-01").cast("date"), "captured")))
    return recall.recall(n, asked, 5, {"status": "active"}, {"status": "status"}, n.where("lang = 'es'").select("path"), decay)
