"""Which design governs a path, which plans touch the same files, which roots lie in others: path patterns by equi-join.

A pattern's fixed part up to the folder before its first wildcard is a prefix of whatever it matches. So a path is
joined by its own prefixes, and only patterns with the same fixed folder are tried on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.steps import once


def clean(path: Column) -> Column:
    """Without white space and slashes at the ends, with forward slashes."""
    return F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "^/+|/+$", "")


def prefixes(path: Column) -> Column:
    """The path, the folders above it, and the empty root."""
    parts = F.split(path, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def is_glob(pattern: Column) -> Column:
    return pattern.rlike(r"[*?\[]")


def fixed_folder(pattern: Column) -> Column:
    """The folder before the first wildcard; a pattern without wildcards is its own."""
    return F.when(is_glob(pattern), F.regexp_extract(F.regexp_replace(pattern, r"[*?\[].*$", ""), "^(.*)/", 1)).otherwise(pattern)


def glob_regex(pattern: Column) -> Column:
    """A shell pattern as a regular expression: ``*`` and ``?`` also stand for slashes."""
    escaped = F.regexp_replace(pattern, r"([\\.^$+{}|()])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(escaped, F.lit("[!"), F.lit("[^")), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def _glob_base(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"[/*]+$", "")


def governing_design(targets: DataFrame, entries: DataFrame, target: str = "target") -> DataFrame:
    """(target, governed, design, area, reason) for each target, a path or the name of an area, from the entries
    (design, area, pattern).

    An area's name gives its first design. Else the longest pattern that is the path, a folder above it, or a glob that
    matches decides; two designs of one length are an overlap, none is a greenfield. Blank targets are greenfield.
    """
    asked = once(targets.select(target).distinct(), _t=clean(F.coalesce(F.col(target), F.lit(""))))
    named = entries.where("area IS NOT NULL").groupBy("area").agg(F.min("design").alias("design"))
    by_area = asked.join(named, F.trim(target) == F.col("area")).select(target, "design", "area")
    known = once(entries.select("design", "area", clean(F.col("pattern")).alias("pattern")), _folder=fixed_folder(F.col("pattern")))
    known = known.where("pattern <> ''").withColumn("_rx", F.when(is_glob(F.col("pattern")), glob_regex(F.col("pattern"))))
    known = known.withColumn("_under", F.when(F.col("_rx").isNotNull(), glob_regex(F.concat(_glob_base(F.col("pattern")), F.lit("/*")))))
    met = asked.where("_t <> ''").select(target, "_t", F.explode(prefixes(F.col("_t"))).alias("_folder")).join(known, "_folder")
    hit = F.col("_rx").isNull() | F.expr("_t RLIKE _rx") | F.expr("_t RLIKE _under")
    length = F.length(F.when(F.col("_rx").isNull(), F.col("pattern")).otherwise(_glob_base(F.col("pattern"))))
    scored = met.where(hit).select(target, F.struct("design", "area").alias("_d"), length.alias("_n")).distinct()
    # The designs of the longest pattern: two of them are enough to know.
    best = scored.groupBy(target, "_n").agg(F.min("_d").alias("one"), F.max("_d").alias("two")).groupBy(target).agg(F.max_by(F.struct("one", "two"), "_n").alias("b"))
    by_path = best.select(target, F.col("b.one").alias("_one"), (F.col("b.one") == F.col("b.two")).alias("_single"))
    found = asked.join(by_area.withColumnsRenamed({target: "_k", "design": "_design", "area": "_area"}), F.col(target) == F.col("_k"), "left")
    found = found.join(by_path.withColumnRenamed(target, "_p"), F.col(target) == F.col("_p"), "left")
    governed = F.col("_k").isNotNull() | F.coalesce("_single", F.lit(False))
    reason = F.when(governed, "governed").when(F.col("_p").isNotNull(), "overlap").otherwise("greenfield")
    pick = lambda own, c: F.when(F.col("_k").isNotNull(), F.col(own)).when(governed, F.col(f"_one.{c}"))
    return found.select(target, governed.alias("governed"), pick("_design", "design").alias("design"), pick("_area", "area").alias("area"), reason.alias("reason"))


def _meeting(patterns: DataFrame) -> DataFrame:
    """(pattern, other): patterns of which one matches the other; a pattern also meets itself if it matches its own letters."""
    known = once(patterns.select(F.col("pattern").alias("other")), _folder=fixed_folder(F.col("other")), _rx=glob_regex(F.col("other")))
    names = patterns.select("pattern", F.explode(prefixes(F.col("pattern"))).alias("_folder"))
    hit = names.join(known, "_folder").where(F.expr("pattern RLIKE _rx")).select("pattern", "other")
    return hit.unionByName(hit.select(F.col("other").alias("pattern"), F.col("pattern").alias("other"))).distinct()


#: Rows that share one copy of a list.
_SHARE = 64


def _beside(rows: DataFrame, lists: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with the list of their key, if it has one. A list of many rows goes to as many tasks, in copies."""
    parts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / _SHARE).cast("int").alias("_parts"))
    copies = lists.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    dealt = rows.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    # A number of partitions of its own, as small rows with long lists would else be put together.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, key, "_part").join(copies, [key, "_part"], "left").drop("_part")


def overlapping_plans(touches: DataFrame) -> DataFrame:
    """(slug, other): plans of which a pattern of one matches a pattern of the other, from (slug, pattern)."""
    p = touches.select("slug", "pattern").distinct()
    others = p.select(F.col("slug").alias("_other"), F.col("pattern").alias("other"))
    met = p.join(_meeting(p.select("pattern").distinct()), "pattern").join(others, "other")
    return met.where("slug <> _other").select("slug", F.col("_other").alias("other")).distinct()


def readiness(plans: DataFrame) -> DataFrame:
    """(slug, verdict, because) of plans (slug, status, queued, depends_on, touches): a queued plan waits for what it
    depends on until that is done; else it is safe beside the others that are ready, overlaps with some, or has not
    said what it touches. ``because`` names the others, in order.

    Patterns meet once each, however many plans have them. The plans around a pattern are listed once and put beside
    the plans that have it, so pairs of plans are never rows; the lists of the result are all that is of that size.
    """
    q = plans.where("queued")
    done = plans.where("status = 'done'").select(F.col("slug").alias("needs")).distinct()
    unmet = q.select("slug", F.explode("depends_on").alias("needs")).join(done, "needs", "left_anti").groupBy("slug").agg(F.array_sort(F.collect_set("needs")).alias("unmet"))
    state = q.select("slug", "touches").join(unmet, "slug", "left")
    ready = state.where("unmet IS NULL").select("slug", F.explode("touches").alias("pattern")).where("pattern IS NOT NULL").distinct()
    every = lambda lists: F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists))))
    owners = ready.groupBy(F.col("pattern").alias("other")).agg(F.collect_list("slug").alias("_slugs"))
    around = _beside(_meeting(ready.select("pattern").distinct()), owners, "other", "pattern").groupBy("pattern").agg(every("_slugs").alias("_around"))
    # Most plans have one pattern; those of several have the lists of each.
    touched = ready.groupBy("slug").agg(F.min("pattern").alias("pattern"), (F.count("*") > 1).alias("_several"))
    state = state.join(touched, "slug", "left").withColumn("_several", F.coalesce("_several", F.lit(False)))
    one = _beside(state.where("NOT _several"), around, "pattern", "slug")
    spread = ready.join(touched.where("_several").select("slug"), "slug", "left_semi")
    lists = _beside(spread, around, "pattern", "slug").groupBy("slug").agg(every("_around").alias("_around"))
    several = state.where("_several").join(lists, "slug", "left").select(*one.columns)
    found = one.unionByName(several).withColumn("others", F.array_remove("_around", F.col("slug")))
    none = F.array().cast("array<string>")
    overlaps = F.coalesce(F.size("others"), F.lit(0)) > 0
    verdict = F.when(F.col("unmet").isNotNull(), "waiting").when(F.coalesce(F.size("touches"), F.lit(0)) <= 0, "undeclared").when(overlaps, "overlaps").otherwise("safe")
    return found.select("slug", verdict.alias("verdict"), F.coalesce("unmet", "others", none).alias("because"))


def outer_roots(roots: DataFrame) -> DataFrame:
    """(root, kind) without the roots of kind ``marker`` that are or hold one of kind ``repos``: those are the real ones."""
    r = roots.select(clean(F.col("root")).alias("root"), "kind").distinct()
    inner = r.where("kind = 'repos'").select(F.explode(prefixes(F.col("root"))).alias("root")).distinct()
    return r.where("kind = 'repos'").unionByName(r.where("kind <> 'repos'").join(inner, "root", "left_anti").select("root", "kind"))
