"""Queries of designs and plans by path, and of stages whose counts leave the usual."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import anomaly, governance
from quernel.plans.book import Book
from quernel.sources.tables import NOTES, notes, table

BOOK = Book()
q = BOOK.query

#: Designs of nations: folders, files, globs with and without a fixed folder; some overlap.
_PATTERN = """CASE n_nationkey % 6 WHEN 0 THEN 'src' || CAST(n_nationkey AS VARCHAR(9)) || '/' WHEN 1 THEN 'src' || CAST(n_nationkey AS VARCHAR(9)) || '/en' WHEN 2 THEN 'src' || CAST(n_nationkey AS VARCHAR(9)) || '/d*'
 WHEN 3 THEN '*/fr/n[1-4]*.md' WHEN 4 THEN 'src' || CAST(n_nationkey AS VARCHAR(9)) || '/e?/**' ELSE '_inbox/*/n' || CAST(n_nationkey AS VARCHAR(9)) || '*' END"""
_ENTRIES = f"en AS (SELECT n_name AS design, 'r' || CAST(n_regionkey AS VARCHAR(9)) AS area, trim({_PATTERN}, '/') AS pattern FROM nation)"
_RX = "'^' || replace(replace(replace(regexp_replace({p}, '([\\\\.^$+{{}}|()])', '\\\\\\1', 'g'), '[!', '[^'), '*', '.*'), '?', '.') || '$'"
_BASE = "regexp_replace(pattern, '[/*]+$', '')"


def _entries(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("design"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("area"), F.expr(_PATTERN).alias("pattern"))


@q(f"""WITH {NOTES}, {_ENTRIES}, t AS (SELECT path AS target FROM notes UNION SELECT 'r' || CAST(r_regionkey AS VARCHAR) FROM region),
 m AS (SELECT target, design, area, length(CASE WHEN regexp_matches(pattern, '[*?\\[]') THEN {_BASE} ELSE pattern END) AS n FROM t, en
  WHERE target = pattern OR (NOT regexp_matches(pattern, '[*?\\[]') AND starts_with(target, pattern || '/')) OR (regexp_matches(pattern, '[*?\\[]') AND (regexp_matches(target, {_RX.format(p='pattern')}) OR regexp_matches(target, {_RX.format(p=f"{_BASE} || '/*'")})))),
 b AS (SELECT target, count(DISTINCT (design, area)) AS k, min(design) AS design, min(area) AS area FROM m JOIN (SELECT target, max(n) AS n FROM m GROUP BY 1) USING (target, n) GROUP BY 1), a AS (SELECT area AS target, min(design) AS design FROM en GROUP BY 1)
 SELECT target, a.design IS NOT NULL OR coalesce(k = 1, false) AS governed, CASE WHEN a.design IS NOT NULL THEN a.design WHEN k = 1 THEN b.design END AS design, CASE WHEN a.design IS NOT NULL THEN target WHEN k = 1 THEN b.area END AS area,
 CASE WHEN a.design IS NOT NULL OR k = 1 THEN 'governed' WHEN k > 1 THEN 'overlap' ELSE 'greenfield' END AS reason FROM t LEFT JOIN a USING (target) LEFT JOIN b USING (target)""")
def governing_designs(spark, d):
    targets = notes(spark, d).select(F.col("path").alias("target")).union(table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))))
    return governance.governing_design(targets, _entries(spark, d))


#: Suppliers as plans: what one touches may lie in what another does.
_TOUCH = "CASE s_suppkey % 4 WHEN 0 THEN 'lib/' || CAST(s_nationkey AS VARCHAR(9)) || '/' || s_name WHEN 1 THEN 'lib/' || CAST(s_nationkey AS VARCHAR(9)) || '/*' WHEN 2 THEN 'app/' || s_name || '/**' ELSE 'app/*/x' END"
_PLANS = f"pl AS (SELECT s_name AS slug, s_suppkey % 5 <> 0 AS queued, CASE WHEN s_suppkey % 5 = 0 THEN 'done' ELSE 'queued' END AS status, s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN {_TOUCH} END AS touch FROM supplier)"


@q(f"""WITH {_PLANS}, dep AS (SELECT a.slug, b.slug AS needs FROM pl a JOIN pl b ON b.s_suppkey = a.s_suppkey - 1 WHERE a.queued AND a.s_suppkey % 3 = 0 AND b.status <> 'done'),
 r AS (SELECT slug, touch FROM pl WHERE queued AND slug NOT IN (SELECT slug FROM dep)), o AS (SELECT a.slug, string_agg(DISTINCT b.slug, '|' ORDER BY b.slug) AS others FROM r a JOIN r b ON a.slug <> b.slug AND (regexp_matches(a.touch, {_RX.format(p='b.touch')}) OR regexp_matches(b.touch, {_RX.format(p='a.touch')})) GROUP BY 1)
 SELECT slug, CASE WHEN needs IS NOT NULL THEN 'waiting' WHEN touch IS NULL THEN 'undeclared' WHEN others IS NOT NULL THEN 'overlaps' ELSE 'safe' END AS verdict, coalesce(needs, others, '') AS because FROM pl LEFT JOIN dep USING (slug) LEFT JOIN o USING (slug) WHERE queued""")
def plan_readiness(spark, d):
    s = table(spark, d, "supplier")
    before = s.select((F.col("s_suppkey") + 1).alias("_k"), F.col("s_name").alias("_before"))
    needs = F.when(F.col("s_suppkey") % 3 == 0, F.array_compact(F.array("_before"))).otherwise(F.array().cast("array<string>"))
    plans = s.join(before, F.col("s_suppkey") == F.col("_k"), "left").select(
        F.col("s_name").alias("slug"), F.when(F.col("s_suppkey") % 5 == 0, "done").otherwise("queued").alias("status"), (F.col("s_suppkey") % 5 != 0).alias("queued"),
        needs.alias("depends_on"), F.array_compact(F.array(F.when(F.col("s_suppkey") % 7 != 0, F.expr(_TOUCH)))).alias("touches"))
    return governance.readiness(plans).withColumn("because", F.array_join("because", "|"))


@q(f"""WITH {NOTES}, r AS (SELECT DISTINCT regexp_replace(path, '/[^/]+$', '') AS root, 'repos' AS kind FROM notes WHERE lang = 'de' UNION SELECT DISTINCT split_part(path, '/', 1), 'marker' FROM notes UNION SELECT DISTINCT regexp_replace(path, '/[^/]+$', ''), 'marker' FROM notes)
 SELECT root, kind FROM r WHERE kind = 'repos' OR root NOT IN (SELECT root FROM r WHERE kind = 'repos' UNION SELECT split_part(root, '/', 1) FROM r WHERE kind = 'repos')""")
def corpus_roots(spark, d):
    n = notes(spark, d)
    folder = F.regexp_replace("path", "/[^/]+$", "")
    roots = n.where("lang = 'de'").select(folder.alias("root"), F.lit("repos").alias("kind")).union(n.select(F.split("path", "/")[0], F.lit("marker"))).union(n.select(folder, F.lit("marker")))
    return governance.outer_roots(roots)


_COUNTS = "ct AS (SELECT event_type AS stage, epoch(date_trunc('hour', ts))::BIGINT AS cycle, CAST(floor(sum(value) * 10) AS BIGINT) AS n FROM events GROUP BY 1, 2)"


@q(f"""WITH RECURSIVE {_COUNTS}, o AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY cycle) AS k FROM ct),
 f AS (SELECT stage, 0::BIGINT AS k, NULL::BIGINT AS cycle, NULL::BIGINT AS n, NULL::DOUBLE AS baseline, NULL::DOUBLE AS threshold, false AS tripped, []::BIGINT[] AS h FROM (SELECT DISTINCT stage FROM ct)
 UNION ALL SELECT f.stage, o.k, o.cycle, o.n, list_avg(f.h), list_avg(f.h) * {anomaly.FACTOR}, t, CASE WHEN t THEN f.h ELSE (list_append(f.h, o.n))[-{anomaly.WINDOW}:] END
 FROM f JOIN o ON o.stage = f.stage AND o.k = f.k + 1, LATERAL (SELECT o.n <> 0 AND len(f.h) >= {anomaly.LEAST} AND o.n > list_avg(f.h) * {anomaly.FACTOR} AS t))
 SELECT stage, cycle, n, round(baseline, 6) AS baseline, round(threshold, 6) AS threshold, tripped FROM f WHERE k > 0""")
def stage_anomalies(spark, d):
    hour = F.unix_timestamp(F.date_trunc("hour", "ts"))
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("stage"), hour.alias("cycle")).agg(F.floor(F.sum("value") * 10).alias("n"))
    found = anomaly.stage_anomalies(counts, "stage", "cycle", "n")
    return found.withColumns({c: F.round(c, 6) for c in ("baseline", "threshold")})
