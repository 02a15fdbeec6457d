"""Recall over notes: a lexical ranking of what is admissible and fits the filter, weighed by age; where no word of a
question is found, what fits the filter alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators import lexical, lint
from quernel.operators.fusion import RRF_K
from quernel.operators.loops import held

#: Folders that are never recalled, those that are on demand, notes that sum others up, and how much ahead
#: of an equal note these are.
NEVER, INBOX, ARCHIVE, ANCHORS, LIFT = ("scratch",), "_inbox", "_archive", ("_index", "_summary"), 1e-6
#: Places of a ranking that are looked at first, and how many times more where these don't settle the best.
REACH, STEP, LAST = 256, 16, 1 << 16


def admissible(path: Column, inbox: bool = False, archive: bool = False) -> Column:
    """Whether no folder of a path keeps it from being recalled; hidden folders do."""
    kept = [*NEVER, *([] if inbox else [INBOX]), *([] if archive else [ARCHIVE])]
    parts = F.split(path, "/")
    return ~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda f: f.isin(*kept) | f.startswith("."))


def live(notes: DataFrame, criteria: dict[str, str], columns: dict[str, str], inbox: bool = False, archive: bool = False) -> DataFrame:
    """The notes that may be recalled: admissible, not superseded, and such as the criteria ask for."""
    current = ~F.coalesce(F.col("status") == "superseded", F.lit(False))
    return notes.where(admissible(F.col("path"), inbox, archive) & current & lint.matches(criteria, columns))


def recall(
    notes: DataFrame, queries: DataFrame, k: int, criteria: dict[str, str] | None = None, columns: dict[str, str] | None = None,
    loaded: DataFrame | None = None, decay: Column | None = None, inbox: bool = False, archive: bool = False, digits: int = 9,
) -> DataFrame:
    """(query_id, path, keyword, score, rank): the ``k`` best notes (path, stem, status, body) for each of the queries
    (query_id, term).

    A note's place in its query's ranking gives it 1 / (60 + rank), notes that sum others up a little more, and its
    ``decay`` (a column of notes) weighs that. Notes that are ``loaded`` (path) already keep their places and are left
    out. A query that finds nothing has, if there are criteria, the first notes that fit them; without, nothing.

    Tasks give the first places of each ranking only. Where the ``k``-th best of these is no better than a note behind
    them could be at most, more places are taken, in the end all.
    """
    criteria = criteria or {}
    docs = live(notes, criteria, columns or {}, inbox, archive)
    lift = F.when(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "").isin(*ANCHORS), LIFT).otherwise(0.0)
    weights = docs.select("path", lift.alias("lift"), (F.lit(1.0) if decay is None else decay).alias("decay"))
    gone = None if loaded is None else held(loaded.select("path").distinct())[0]
    scores = lexical.matched_scores(docs, queries, "body", "path")

    def places(reach: int | None, only: DataFrame | None = None) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("keyword", digits).desc(), "path"))
        ranked = scores(reach, 2 * 10.0**-digits, only).withColumnRenamed("score", "keyword").withColumn("place", place)
        ranked = (ranked.where(F.col("place") <= reach) if reach else ranked).join(weights, "path")
        return ranked.withColumn("gone", F.lit(False)) if gone is None else ranked.join(gone.withColumn("gone", F.lit(True)), "path", "left")

    def left(ranked: DataFrame) -> DataFrame:
        return ranked.where("gone IS NOT TRUE").select("query_id", "path", "keyword", "lift", "decay", (1 / (RRF_K + F.col("place"))).alias("fused"))

    def best(fused: DataFrame) -> DataFrame:
        combined = fused.select("query_id", "path", F.round("keyword", digits).alias("keyword"), F.round((F.col("fused") + F.col("lift")) * F.col("decay"), 12).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path")
        return combined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    lift, weight = weights.agg(F.max("lift"), F.greatest(F.max(F.col("decay").cast("double")), F.lit(0.0))).first()
    reach: int | None = max(REACH, k)
    ranked, _ = held(places(reach))
    while reach:
        behind = F.round((1 / (RRF_K + F.lit(reach + 1)) + lift) * weight, 12)
        settled = best(left(ranked)).where((F.col("rank") == k) & (F.col("score") > behind)).select("query_id")
        rest, n = held(ranked.where(F.col("place") == reach).select("query_id").join(settled, "query_id", "left_anti"))
        if not n:
            break
        reach = reach * STEP if reach < LAST else None
        ranked, _ = held(ranked.join(rest, "query_id", "left_anti").unionByName(places(reach, rest)))
    if not criteria:
        return best(left(ranked))
    # What fits the filter alone is the same for every query without words, so its first k are found once.
    few = weights if gone is None else weights.join(gone, "path", "left_anti")
    few = few.orderBy((F.col("lift") * F.col("decay")).desc(), "path").limit(k).agg(F.collect_list(F.struct("path", F.lit(0.0).alias("keyword"), "lift", "decay")).alias("few"))
    lost = queries.select("query_id").distinct().join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    return best(left(ranked).unionByName(lost.join(F.broadcast(few)).select("query_id", F.inline("few"), F.lit(0.0).alias("fused"))))
