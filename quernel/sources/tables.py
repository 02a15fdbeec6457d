"""Tables of the input folder, and the note-shaped views that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: path, stem, title, meta, body, status, flags, dates, links.

    The documents carry no front matter and no links, so these come from the id by rule; SQL states the
    same rule in ``NOTES``.
    """
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    status = F.when(i % 10 == 0, "superseded").when(i % 10 == 1, "inbox").when(i % 10 == 2, "unfiled").otherwise("active")
    space = F.when(i % 7 == 0, "_inbox").when(i % 11 == 0, "_archive").otherwise(F.col("source"))
    day = F.to_timestamp(F.lit("2023-01-01 00:00:00"))
    return d.select(
        i.alias("doc_id"),
        F.concat(space, F.lit("/"), F.col("lang"), F.lit("/n"), i.cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("n"), i.cast("string")).alias("stem"),
        F.substring(F.split("text", "\n")[0], 1, 60).alias("title"),
        F.concat_ws(" ", "lang", "source").alias("meta"),
        F.col("text").alias("body"),
        "lang",
        "source",
        status.alias("status"),
        F.array_compact(
            F.array(
                F.when(i % 7 == 0, "space"), F.when(i % 13 == 0, "fragment"), F.when(i % 17 == 0, "artifact"),
                F.when((i % 10).isin(0, 1, 2), "status"), F.when(i % 5 == 0, "durable"),
            )
        ).alias("flags"),
        (day + F.make_interval(days=(i % 700).cast("int"))).alias("captured"),
        F.when(i % 3 == 0, F.lit("frontmatter")).otherwise("mtime").alias("captured_src"),
        F.when(i % 4 == 0, day + F.make_interval(days=((i * 3) % 720).cast("int"))).alias("updated"),
        F.when(i % 6 != 0, (i % 101) / F.lit(100.0)).alias("confidence"),
    )


#: The same view in SQL.
NOTES = """notes AS (
  SELECT doc_id,
    CASE WHEN doc_id % 7 = 0 THEN '_inbox' WHEN doc_id % 11 = 0 THEN '_archive' ELSE source END
      || '/' || lang || '/n' || CAST(doc_id AS VARCHAR) || '.md' AS path,
    'n' || CAST(doc_id AS VARCHAR) AS stem,
    substr(string_split(text, chr(10))[1], 1, 60) AS title,
    lang || ' ' || source AS meta, text AS body, lang, source,
    CASE doc_id % 10 WHEN 0 THEN 'superseded' WHEN 1 THEN 'inbox' WHEN 2 THEN 'unfiled' ELSE 'active' END AS status,
    list_filter([CASE WHEN doc_id % 7 = 0 THEN 'space' END, CASE WHEN doc_id % 13 = 0 THEN 'fragment' END,
      CASE WHEN doc_id % 17 = 0 THEN 'artifact' END, CASE WHEN doc_id % 10 IN (0, 1, 2) THEN 'status' END,
      CASE WHEN doc_id % 5 = 0 THEN 'durable' END], lambda f: f IS NOT NULL) AS flags,
    TIMESTAMP '2023-01-01' + to_days(CAST(doc_id % 700 AS INTEGER)) AS captured,
    CASE WHEN doc_id % 3 = 0 THEN 'frontmatter' ELSE 'mtime' END AS captured_src,
    CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2023-01-01' + to_days(CAST((doc_id * 3) % 720 AS INTEGER)) END AS updated,
    CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 101) / 100.0 END AS confidence
  FROM documents)"""


def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three links of each note by rule: two to other notes, one of which may not exist, and its series."""
    n = notes(spark, sf_dir)
    i = F.col("doc_id")
    return n.select(
        F.col("path").alias("source_path"),
        F.col("stem").alias("source_stem"),
        F.explode(
            F.array(
                F.concat(F.lit("n"), ((i * 7 + 3) % 1300).cast("string")),
                F.concat(F.lit("n"), (i % 40).cast("string")),
                F.concat(F.lit("series-"), (i % 9).cast("string")),
            )
        ).alias("target"),
    )


LINKS = """links AS (
  SELECT path AS source_path, stem AS source_stem, unnest(['n' || CAST((doc_id * 7 + 3) % 1300 AS VARCHAR),
    'n' || CAST(doc_id % 40 AS VARCHAR), 'series-' || CAST(doc_id % 9 AS VARCHAR)]) AS target FROM notes)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as markdown files with front matter, headings, a fence, links and entity references."""
    n = notes(spark, sf_dir)
    i = F.col("doc_id").cast("string")
    raw = F.concat(
        F.lit('---\ntitle: "Note '), i, F.lit('"\nstatus: '), F.initcap("status"), F.lit("\ntags: [Lang-"), F.col("lang"),
        F.lit(", "), F.col("source"), F.lit("]\nkind: decision\ncaptured: "), F.date_format("captured", "yyyy-MM-dd"),
        F.when(F.col("doc_id") % 8 == 0, F.lit("\nprobe: yes")).otherwise(""),
        F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("\nsupersedes: n"), ((F.col("doc_id") - 3)).cast("string"))).otherwise(""),
        F.lit("\n---\n# Head "), i, F.lit("\n"), F.col("body"), F.lit("\n```\n[[fenced]]\n```\n## Sub\nSee [[n"),
        (F.col("doc_id") % 40).cast("string"), F.lit("#part|other]] and issue #"), i, F.lit(" of acme/tool.\n"),
    )
    return n.select("doc_id", "path", "stem", raw.alias("raw"))


MARKDOWN = """md AS (
  SELECT doc_id, path, stem, '---' || chr(10) || 'title: "Note ' || CAST(doc_id AS VARCHAR) || '"' || chr(10) || 'status: '
    || upper(substr(status, 1, 1)) || substr(status, 2) || chr(10) || 'tags: [Lang-' || lang || ', ' || source || ']' || chr(10)
    || 'kind: decision' || chr(10) || 'captured: ' || strftime(captured, '%Y-%m-%d')
    || CASE WHEN doc_id % 8 = 0 THEN chr(10) || 'probe: yes' ELSE '' END
    || CASE WHEN doc_id % 10 = 3 THEN chr(10) || 'supersedes: n' || CAST(doc_id - 3 AS VARCHAR) ELSE '' END
    || chr(10) || '---' || chr(10) || '# Head ' || CAST(doc_id AS VARCHAR) || chr(10) || body || chr(10)
    || '```' || chr(10) || '[[fenced]]' || chr(10) || '```' || chr(10) || '## Sub' || chr(10) || 'See [[n'
    || CAST(doc_id % 40 AS VARCHAR) || '#part|other]] and issue #' || CAST(doc_id AS VARCHAR) || ' of acme/tool.' || chr(10) AS raw
  FROM notes)"""
