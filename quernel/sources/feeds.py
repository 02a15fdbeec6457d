"""Feeds: the items of RSS, RDF and Atom bodies as one table, and those that were not seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import text as X

#: Fixed value: items of a feed that count, from its newest on.
MOST_ITEMS = 20
_ITEM = (
    "ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _VALUE: STRING>>, description: STRING, summary: STRING, content: STRING, "
    "encoded: STRING, category: ARRAY<STRUCT<_term: STRING, _VALUE: STRING>>>>"
)
_FEED = f"STRUCT<channel: STRUCT<item: {_ITEM}>, item: {_ITEM}, entry: {_ITEM}, _corrupt_record: STRING>"
#: Entities that a text out of XML may still hold. Fixed values.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def looks_like_feed(body: Column) -> Column:
    """Whether the first 200 characters are those of an XML, RSS or Atom body."""
    head = F.lower(F.substring(F.ltrim(F.regexp_replace(body, r"^\s+", "")), 1, 200))
    return head.startswith("<?xml") | F.contains(head, F.lit("<rss")) | F.contains(head, F.lit("<feed"))


def visible_text(html: Column) -> Column:
    """What is left without scripts, styles and tags, entities resolved, white space as single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    for entity, character in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(character))
    return X.flat(F.translate(bare, " ", " "))


def _first(values: Column) -> Column:
    """The first of an array that is neither null nor blank."""
    return F.coalesce(F.get(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), F.lit(0)), F.lit(""))


def _read(item: Column) -> Column:
    """One item: title, body, link and categories, each the first that has something."""
    body = _first(F.array(*(item[c] for c in ("description", "summary", "content", "encoded"))))
    links = F.transform(item["link"], lambda k: F.coalesce(k["_href"], k["_VALUE"]))
    named = F.transform(item["category"], lambda c: F.trim(F.coalesce(F.nullif(c["_term"], F.lit("")), c["_VALUE"])))
    some = F.coalesce(F.filter(named, lambda c: c != ""), F.array().cast("array<string>"))
    return F.struct(_first(F.array(item["title"])).alias("title"), F.when(F.contains(body, F.lit("<")), visible_text(body)).otherwise(body).alias("body"),
                    F.coalesce(_first(links), F.lit("")).alias("link"), some.alias("categories"))


def feed_items(feeds: DataFrame, body: str, key: str, url: str, wanted: tuple[str, ...] = (), most: int = MOST_ITEMS) -> DataFrame:
    """(key, place, title, body, url, categories): the first ``most`` items of each feed that have a title or a body and,
    if categories are ``wanted``, one of these in whatever case. An item without link has its feed's URL, one without
    title the feed's key. A body that is null, empty or no well-formed XML has no items."""
    parsed = feeds.select(key, url, F.explode(F.array(F.from_xml(F.col(body), _FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}))).alias("_feed"))
    empty = F.array().cast(_ITEM)
    items = F.concat(*(F.coalesce(F.col(c), empty) for c in ("_feed.channel.item", "_feed.item", "_feed.entry")))
    read = parsed.where("_feed._corrupt_record IS NULL").select(key, url, F.explode(F.array(F.transform(items, _read))).alias("_items"))
    low = F.array(*(F.lit(w.lower()) for w in wanted)).cast("array<string>")
    kept = F.filter("_items", lambda i: ((i["title"] != "") | (i["body"] != "")) & (F.arrays_overlap(F.transform(i["categories"], lambda c: F.lower(c)), low) if wanted else F.lit(True)))
    rows = read.select(key, url, F.posexplode(F.slice(kept, 1, most)).alias("place", "_i"))
    title, link = (F.coalesce(F.nullif(F.col(f"_i.{c}"), F.lit("")), other) for c, other in (("title", F.col(key).cast("string")), ("link", F.col(url))))
    return rows.select(key, "place", title.alias("title"), F.col("_i.body").alias("body"), link.alias("url"), F.col("_i.categories").alias("categories"), F.col(url).alias("feed_url"))


def identity(url: Column, feed_url: Column, body: Column) -> Column:
    """An item's own URL; of one that only has its feed's, a hash of its content."""
    content = F.concat(F.lit("content:"), F.substring(F.sha2(body, 256), 1, 16))
    return F.when((url != "") & ~url.eqNullSafe(feed_url), url).otherwise(content)


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Items whose identity their feed has not had before; of those alike within one scan the first."""
    named = items.withColumn("identity", identity(F.col("url"), F.col("feed_url"), F.col("body")))
    new = named.join(seen.select(key, "identity").distinct(), [key, "identity"], "left_anti")
    columns = [c for c in new.columns if c not in (key, "identity")]
    return new.groupBy(key, "identity").agg(F.min_by(F.struct(*columns), "place").alias("_i")).select(key, "identity", *(f"_i.{c}" for c in columns))
