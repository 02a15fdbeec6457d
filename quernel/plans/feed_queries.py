"""Queries of feeds: documents as RSS and Atom bodies whose items are their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.plans.book import Book
from quernel.sources import feeds
from quernel.sources.tables import table

BOOK = Book()
q = BOOK.query

_URL = "'http://' || source || '.example/' || CAST(doc_id AS VARCHAR)"
#: The items that the lines of a document stand for. Every eleventh feed is cut off and has none.
_ITEMS = f"""ln AS (SELECT doc_id, {_URL} AS feed_url, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_id % 11 <> 0),
 it AS (SELECT doc_id, feed_url, i, trim(left(line, 40)) AS title, trim(regexp_replace('x ' || line, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS body, CASE WHEN i % 4 = 3 THEN feed_url ELSE feed_url || '/' || CAST(i // 2 AS VARCHAR) END AS url, i % 3 = 1 AS wanted FROM ln)"""
_FIRST = f"{_ITEMS}, fi AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM it WHERE wanted), f AS (SELECT doc_id, CAST(place AS INT) AS place, CASE WHEN title = '' THEN CAST(doc_id AS VARCHAR) ELSE title END AS title, body, url, feed_url FROM fi WHERE place < 20)"


def _feeds(spark, d):
    """Even documents as RSS, odd ones as Atom."""
    escaped = F.col("text")
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(character), F.lit(entity))
    url = F.concat(F.lit("http://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").select("doc_id", url.alias("url"), escaped.alias("text"))

    def item(atom: bool):
        def make(line, i):
            title = F.replace(F.replace(F.replace(line, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
            title = F.substring(title, 1, 40)
            for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                title = F.replace(title, F.lit(character), F.lit(entity))
            own = F.concat(F.col("url"), F.lit("/"), F.floor(i / 2).cast("string"))
            link = F.when(i % 4 == 3, "").otherwise(F.concat(F.lit('<link href="'), own, F.lit('"/>')) if atom else F.concat(F.lit("<link>"), own, F.lit("</link>")))
            tag = F.concat(F.lit("C"), (i % 3).cast("string"))
            tags = F.concat(F.lit('<category term="'), tag, F.lit('"/>')) if atom else F.concat(F.lit("<category>"), tag, F.lit("</category><category>all</category>"))
            body = F.concat(F.lit("&lt;p&gt;x&lt;/p&gt; "), F.replace(line, F.lit("&"), F.lit("&amp;")))
            name = "summary" if atom else "description"
            kind = "entry" if atom else "item"
            return F.concat(F.lit(f"<{kind}><title>"), title, F.lit("</title>"), link, tags, F.lit(f"<{name}>"), body, F.lit(f"</{name}></{kind}>"))

        return F.array_join(F.transform(F.split("text", "\n"), make), "\n")

    rss = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>'), item(False), F.lit("</channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'), item(True), F.lit("</feed>"))
    body = F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom)
    return docs.select("doc_id", "url", F.when(F.col("doc_id") % 11 == 0, F.substring(body, F.lit(1), F.length(body) - 9)).otherwise(body).alias("body"))


def _wanted(spark, d):
    return feeds.feed_items(_feeds(spark, d), "body", "doc_id", "url", wanted=("c1",))


@q(f"WITH {_FIRST} SELECT doc_id, place, title, sha256(body) AS body, url FROM f")
def feed_items(spark, d):
    return _wanted(spark, d).select("doc_id", "place", "title", F.sha2("body", 256).alias("body"), "url")


@q(f"""WITH {_FIRST}, n AS (SELECT *, CASE WHEN url <> feed_url THEN url ELSE 'content:' || left(sha256(body), 16) END AS identity FROM f),
 u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, identity ORDER BY place) AS k FROM n WHERE identity <> feed_url || '/2') SELECT doc_id, identity, place FROM u WHERE k = 1""")
def feed_unseen(spark, d):
    items = _wanted(spark, d)
    seen = items.select("doc_id", F.concat("feed_url", F.lit("/2")).alias("identity"))
    return feeds.unseen(items, seen, "doc_id").select("doc_id", "identity", "place")
