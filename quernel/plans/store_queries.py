"""Queries of an index' tables and histories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quernel.operators import store
from quernel.plans.book import Book
from quernel.sources.tables import LINKS, NOTES, note_links, notes, table

BOOK = Book()
q = BOOK.query


@q(f"WITH {NOTES}, {LINKS}, g AS (SELECT path FROM notes WHERE status = 'superseded') SELECT 'notes' AS kind, count(*) AS n FROM notes WHERE path NOT IN (FROM g) UNION ALL SELECT 'links', count(*) FROM links WHERE source_path NOT IN (FROM g)")
def store_deleted(spark, d):
    n = notes(spark, d)
    left = store.without_notes({"notes": (n, "path"), "links": (note_links(spark, d), "source_path")}, n.where("status = 'superseded'"))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1])


@q("""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_idx FROM documents), n AS (SELECT doc_id, lang = 'de' AS again, unnest(string_split(text, '. ')) AS content, generate_subscripts(string_split(text, '. '), 1) - 1 AS chunk_idx FROM documents)
 SELECT doc_id, CAST(chunk_idx AS INT) AS chunk_idx, sha256(content) AS hash FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de') UNION ALL SELECT doc_id, CAST(chunk_idx AS INT), sha256(content) FROM n WHERE again AND chunk_idx < 5""")
def store_chunks(spark, d):
    docs = table(spark, d, "documents")
    cut = lambda rows, mark: rows.select("doc_id", F.posexplode(F.split("text", mark)).alias("chunk_idx", "content"))
    changed = docs.where("lang = 'de'")
    found = store.replace_chunks(cut(docs, "\\n"), changed, cut(changed, r"\. ").where("chunk_idx < 5"), "doc_id")
    return found.select("doc_id", "chunk_idx", F.sha2("content", 256).alias("hash"))


_LINE = "CASE WHEN event_id % 13 = 0 THEN '{broken' WHEN event_id % 17 = 0 THEN '{\"user\": 1}' WHEN event_id % 19 = 0 THEN '  ' ELSE '{\"ts\": \"' || {ts} || '\", \"user\": ' || CAST(user_id AS VARCHAR{n}) || '}' END"


@q("WITH l AS (SELECT event_id, " + _LINE.replace("{ts}", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')").replace("{n}", "") + " AS line FROM events), r AS (SELECT event_id, TRY_CAST(TRY_CAST(line AS JSON) ->> '$.ts' AS TIMESTAMP) AS ts FROM l) SELECT event_id FROM r WHERE ts >= TIMESTAMP '2024-01-10 12:00:00'")
def history_pruned(spark, d):
    ts = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    lines = table(spark, d, "events").select("event_id", F.expr(_LINE.replace("{ts}", ts).replace("{n}", "(20)")).alias("line"))
    return store.pruned_history(lines, F.lit(datetime(2024, 1, 30, 12)), 20).select("event_id")
