"""Queries of the link and entity graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators import graph
from quernel.plans.book import Book
from quernel.sources.tables import LINKS, MARKDOWN, NOTES, markdown, note_links, notes, table

BOOK = Book()
q = BOOK.query
_L = f"""WITH {NOTES}, {LINKS}, rs AS (SELECT l.source_path, l.source_stem, l.target, n.path AS resolved FROM links l LEFT JOIN notes n ON l.target = n.stem),
 ed AS (SELECT DISTINCT source_path AS s, resolved AS t FROM rs WHERE resolved IS NOT NULL AND resolved <> source_path),
 dg AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM ed UNION ALL SELECT t FROM ed) GROUP BY 1)"""
#: Each order supersedes the one before of its customer.
_P = "pairs AS (SELECT o_orderkey AS new, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS old FROM orders QUALIFY old IS NOT NULL)"


def _resolved(spark, d):
    return graph.resolve(note_links(spark, d), notes(spark, d).select("path"))


@q(_L + " SELECT source_path, target, resolved FROM rs")
def graph_resolve_links(spark, d):
    return _resolved(spark, d).select("source_path", "target", "resolved")


@q(_L + " SELECT resolved AS path, count(DISTINCT source_path) AS n_sources FROM rs WHERE resolved IS NOT NULL GROUP BY 1")
def graph_backlinks(spark, d):
    return graph.backlinks(_resolved(spark, d))


@q(_L + ", u AS (SELECT DISTINCT target, source_path FROM rs WHERE resolved IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source_path) AS k FROM u) SELECT target, count(*) AS n_sources, string_agg(CASE WHEN k <= 5 THEN source_path END, '|' ORDER BY source_path) AS sources FROM r GROUP BY 1 HAVING count(*) >= 2")
def graph_dangling(spark, d):
    return graph.dangling(_resolved(spark, d), 2)


@q(_L + " SELECT target, count(DISTINCT source_path) AS n FROM links GROUP BY 1 HAVING count(DISTINCT source_path) >= 3")
def graph_recurring_targets(spark, d):
    return note_links(spark, d).groupBy("target").agg(F.count_distinct("source_path").alias("n")).where("n >= 3")


@q(_L + " SELECT node, degree FROM dg")
def graph_degrees(spark, d):
    return graph.degrees(graph.edges(_resolved(spark, d)))


@q(_L + ", tp AS (SELECT node FROM dg ORDER BY degree DESC, node LIMIT 60), ke AS (SELECT * FROM ed WHERE s IN (SELECT node FROM tp) AND t IN (SELECT node FROM tp)), kd AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM ke UNION ALL SELECT t FROM ke) GROUP BY 1) SELECT node, coalesce(degree, 0) AS degree FROM tp LEFT JOIN kd USING (node)")
def graph_hub_cap(spark, d):
    return graph.hub_cap(graph.edges(_resolved(spark, d)), 60)[0]


@q(_L + " SELECT path FROM notes WHERE path NOT IN (SELECT s FROM ed) AND path NOT IN (SELECT t FROM ed)")
def graph_orphans(spark, d):
    return graph.orphans(notes(spark, d).select("path"), graph.edges(_resolved(spark, d)))


@q(_L + ", x AS (SELECT a.path AS a, b.path AS b FROM notes a JOIN notes b ON a.source = b.source AND a.doc_id + 20 = b.doc_id) SELECT a, b FROM x WHERE NOT EXISTS (SELECT 1 FROM ed WHERE (ed.s = x.a AND ed.t = x.b) OR (ed.s = x.b AND ed.t = x.a))")
def graph_unlinked_pairs(spark, d):
    n = notes(spark, d)
    a = n.select(F.col("path").alias("a"), "source", (F.col("doc_id") + 20).alias("to"))
    pairs = a.join(n.select(F.col("path").alias("b"), "source", F.col("doc_id").alias("to")), ["source", "to"]).select("a", "b")
    e = graph.edges(_resolved(spark, d))
    both = e.select(F.col("s").alias("a"), F.col("t").alias("b")).unionAll(e.select(F.col("t").alias("a"), F.col("s").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def _pairs(spark, d):
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("new"), before.alias("old")).where("old is not null")


@q(f"WITH RECURSIVE {_P}, walk(head, tail, length) AS (SELECT new, old, 1 FROM pairs WHERE new NOT IN (SELECT old FROM pairs) UNION ALL SELECT w.head, p.old, w.length + 1 FROM walk w JOIN pairs p ON p.new = w.tail) SELECT head, max(length) AS length, arg_max(tail, length) AS tail FROM walk GROUP BY 1")
def graph_supersession_chains(spark, d):
    return graph.supersession(_pairs(spark, d))[0]


@q("SELECT o_custkey AS target, count(DISTINCT o_orderkey) AS claimants FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2")
def graph_supersede_forks(spark, d):
    return graph.forks(table(spark, d, "orders").select(F.col("o_orderkey").alias("new"), F.col("o_custkey").alias("old")))


#: Rings of forty customers, each with nine that lead to it and one chain of a single link.
_RING = "SELECT c_custkey AS new, CASE WHEN c_custkey % 50 < 40 THEN c_custkey - c_custkey % 50 + (c_custkey % 50 + 1) % 40 WHEN c_custkey % 50 < 49 THEN c_custkey - 1 ELSE -c_custkey END AS old FROM customer"


@q(f"WITH RECURSIVE pairs AS ({_RING}), walk(a, b, n) AS (SELECT new, old, 1 FROM pairs UNION ALL SELECT w.a, p.old, w.n + 1 FROM walk w JOIN pairs p ON p.new = w.b WHERE w.n < 60 AND w.a <> w.b) SELECT DISTINCT a AS node FROM walk WHERE a = b")
def graph_supersede_cycles(spark, d):
    n = F.col("c_custkey")
    i = n % 50
    pairs = table(spark, d, "customer").select(n.alias("new"), F.when(i < 40, n - i + (i + 1) % 40).when(i < 49, n - 1).otherwise(-n).alias("old"))
    return graph.supersession(pairs)[1]


@q(f"""WITH {NOTES}, {MARKDOWN}, e AS (SELECT doc_id, regexp_replace(raw, '(?s)```.*?```', '', 'g') AS t FROM md), u AS (SELECT DISTINCT doc_id, 'issue:n' || unnest(regexp_extract_all(t, '(?m)(?:^|[\\s(\\[])#(\\d{{2,}})\\b', 1)) AS uri FROM e),
 c AS (SELECT uri, count(*) AS mentions FROM u GROUP BY 1) SELECT uri, mentions, (SELECT min(path) FROM notes WHERE stem = split_part(uri, ':', 2)) AS file FROM c""")
def graph_entity_mentions(spark, d):
    e = markdown(spark, d).select("doc_id", F.explode(F.filter(X.entity_uris(F.col("raw")), lambda u: u.startswith("issue:"))).alias("uri"))
    e = e.select(F.regexp_replace("uri", "issue:#", "issue:n").alias("uri"))
    return graph.entity_mentions(e, notes(spark, d).select("path"))


@q(_L + ", r AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) - 1 AS i FROM dg) SELECT node, i, round(10 * sqrt(i + 0.5) * cos(i * pi() * (3 - sqrt(5.0))), 6) AS x, round(10 * sqrt(i + 0.5) * sin(i * pi() * (3 - sqrt(5.0))), 6) AS y FROM (SELECT node, i FROM r WHERE i < 50)")
def graph_phyllotaxis(spark, d):
    top = graph.degrees(graph.edges(_resolved(spark, d))).orderBy(F.col("degree").desc(), "node").limit(50)
    placed = graph.phyllotaxis(top, F.struct(-F.col("degree"), "node"))
    return placed.select("node", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
