"""Link and entity graph: resolution, backlinks, degrees, chains, forks, hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.loops import held


def resolve(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Links with the path that each target names, or null.

    Every suffix of a known path is a key, so this is one equi-join; the longest match wins, then the
    path in the same folder, then the first path.
    """
    parts = F.split(F.regexp_replace("path", r"\.md$", ""), "/")
    keys = paths.select(
        F.col("path").alias("resolved"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))).alias("key"),
    )
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    near = (folder(F.col("resolved")) == folder(F.col("source_path"))).cast("int")
    order = Window.partitionBy("source_path", "target").orderBy(near.desc(), F.col("resolved"))
    wanted = links.select("source_path", "target").distinct()
    found = wanted.join(keys, wanted["target"] == keys["key"]).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return links.join(found.select("source_path", "target", "resolved"), ["source_path", "target"], "left")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct edges between notes, no note to itself."""
    return resolved.where("resolved is not null and resolved <> source_path").select(F.col("source_path").alias("s"), F.col("resolved").alias("t")).distinct()


def degrees(edge: DataFrame) -> DataFrame:
    ends = edge.select(F.col("s").alias("node")).unionAll(edge.select(F.col("t").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def hub_cap(edge: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph on the ``cap`` nodes of highest degree, degrees taken anew."""
    top = degrees(edge).orderBy(F.col("degree").desc(), "node").limit(cap).select("node")
    kept = edge.join(top.withColumnRenamed("node", "s"), "s", "left_semi").join(top.withColumnRenamed("node", "t"), "t", "left_semi")
    return top.join(degrees(kept), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")), kept


def backlinks(resolved: DataFrame) -> DataFrame:
    return resolved.where("resolved is not null").groupBy(F.col("resolved").alias("path")).agg(F.count_distinct("source_path").alias("n_sources"))


def dangling(resolved: DataFrame, least: int = 1, contexts: int = 5) -> DataFrame:
    """Targets that no path answers, with their sources in order; the first few are named."""
    sources = resolved.where("resolved is null").select("target", "source_path").distinct()
    ranked = sources.withColumn("_k", F.row_number().over(Window.partitionBy("target").orderBy("source_path")))
    named = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_k") <= contexts, F.col("source_path")))), "|")
    return ranked.groupBy("target").agg(F.count("*").alias("n_sources"), named.alias("sources")).where(F.col("n_sources") >= least)


def orphans(paths: DataFrame, edge: DataFrame) -> DataFrame:
    """Notes without an edge in or out."""
    return paths.join(edge.select(F.col("s").alias("path")), "path", "left_anti").join(edge.select(F.col("t").alias("path")), "path", "left_anti")


def supersession(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains: head, tail, length), (cycle members: node).

    ``pairs`` is (new, old); of several that a note supersedes the first counts. Every note has a pointer that
    doubles its reach each round, until all have come to an end or the reach is above the number of notes.
    What has not come to an end then stands on a cycle or leads to one, and points to a note on it.
    """
    step, notes = held(pairs.groupBy(F.col("new").alias("a")).agg(F.min("old").alias("b")))
    reach = step.select("a", "b", F.lit(1).cast("long").alias("n"))
    moved, far = notes, 1
    while moved and far <= 2 * notes:
        on = reach.select(F.col("a").alias("b"), F.col("b").alias("_b"), F.col("n").alias("_n"))
        joined = reach.join(on, "b", "left")
        reach, _ = held(joined.select("a", F.coalesce("_b", "b").alias("b"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.col("_b").isNotNull().alias("on")))
        moved = reach.where("on").count()
        reach, far = reach.drop("on"), far * 2
    open_ = reach.join(step.select(F.col("a").alias("b")), "b", "left_semi")
    ended = reach.join(step.select(F.col("a").alias("b")), "b", "left_anti")
    heads = step.select("a").join(pairs.select(F.col("old").alias("a")), "a", "left_anti")
    return ended.join(heads, "a", "left_semi").select(F.col("a").alias("head"), F.col("b").alias("tail"), F.col("n").alias("length")), open_.select(F.col("b").alias("node")).distinct()


def forks(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Notes that several claim to supersede."""
    return pairs.groupBy(F.col("old").alias("target")).agg(F.count_distinct("new").alias("claimants")).where(F.col("claimants") >= least)


def entity_mentions(entities: DataFrame, files: DataFrame, least: int = 1) -> DataFrame:
    """(uri, mentions, file): the file is the first path whose stem is the last part of the uri."""
    counts = entities.groupBy("uri").agg(F.count("*").alias("mentions")).where(F.col("mentions") >= least)
    stem = lambda c: F.lower(F.element_at(F.split(c, "[:/]"), -1))
    by_stem = files.groupBy(stem(F.regexp_replace("path", r"\.md$", "")).alias("stem")).agg(F.min("path").alias("file"))
    return counts.withColumn("stem", stem(F.col("uri"))).join(by_stem, "stem", "left").select("uri", "mentions", "file")


def phyllotaxis(nodes: DataFrame, by: Column) -> DataFrame:
    """Seed places of a layout, in the order of ``by``: radius 10 * sqrt(0.5 + i), angle i * pi * (3 - sqrt(5))."""
    i = F.col("i")
    turn = F.pi() * (3 - F.sqrt(F.lit(5.0)))
    r = 10 * F.sqrt(i + 0.5)
    ranked = nodes.withColumn("i", F.row_number().over(Window.orderBy(by)) - 1)
    return ranked.withColumns({"x": r * F.cos(i * turn), "y": r * F.sin(i * turn)})
