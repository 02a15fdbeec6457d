"""Quality rules with host verdicts [native: DataFrame functions only].

Each document gets counts over its whole text; rules compare integers, so every engine decides alike.
Rule failures are summed by host, the failure rate of a host is shrunk towards an empirical beta
prior fitted to all hosts, and the verdict on the host is joined back: a document of a failed host
that breaks a rule itself is dropped. A document that breaks no rule is always kept.

Defined cases: a null text is an empty text (no words, so ``base_failed``); a null host is a host of
its own; repeated rows are rows of their own; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.durable import cut

SPACE = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]"


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules. All are compared as integers."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 20
    max_duplicate_line_percent: int = 30
    max_mean_word_chars: int = 15
    #: A host fails if its shrunk failure rate is above this.
    host_rate: float = 0.5


def _staged(df: DataFrame, text: str) -> DataFrame:
    """Adds the counts. Each step is a projection of its own, so no step is evaluated twice."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns(
        {
            "_w": F.array_remove(F.split("_t", SPACE + "+"), ""),
            "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)),
            "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            # The hash of the three words that start at each place.
            "_g": F.when(
                F.size("_w") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("_w") - 3),
                    lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
                ),
            ),
        }
    ).drop("_w", "_l", "_t")
    # Only texts with a repeated window need to know which windows repeat.
    df = df.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("p")))),
        ),
    ).drop("_g")

    def repeated(e: Column, k: Column) -> Column:
        around = (F.get("_s", k - 1)["g"] == e["g"]) | (F.get("_s", k + 1)["g"] == e["g"])
        return F.when(around, e["p"])

    df = df.withColumn("_p", F.sort_array(F.array_compact(F.transform("_s", repeated)))).drop("_s")
    covered = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    return df.withColumn(
        "n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    ).drop("_p")


def document_counts(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The columns of ``docs`` with the counts of each text and the number of rules it breaks, in place of columns of
    these names; all other columns stay as they are, whatever they are called."""
    counted = _counts(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text", rules)
    new = [c for c in counted.columns if c not in ("row", "text")]
    return counted.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in new), *new)


def _counts(docs: DataFrame, text: str, rules: QualityRules) -> DataFrame:
    df = _staged(docs, text)
    base = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    soft = [
        F.col("n_symbols") * 100 > F.col("n_words") * rules.max_symbol_percent,
        F.col("n_dup_lines") * 100 > F.col("n_lines") * rules.max_duplicate_line_percent,
        F.col("word_chars") > F.col("n_words") * rules.max_mean_word_chars,
    ]
    return df.withColumn("base_failed", base).withColumn(
        "n_failures", sum((c.cast("int") for c in soft), F.col("base_failed").cast("int"))
    )


def host_verdicts(counts: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per host: documents, failures, the shrunk rate and the verdict.

    The beta prior has the mean and variance of the hosts' own rates (method of moments). Hosts are
    summed before they are shuffled, so a host with a third of all rows is one row per task.
    """
    hosts = counts.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum((F.col("n_failures") > 0).cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    mean, var = mean or 0.0, var or 0.0
    # Equal rates, or rates that no beta has, say nothing of the spread: one pseudo-document then.
    weight = mean * (1 - mean) / var - 1 if 0 < var < mean * (1 - mean) else 1.0
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_failed", shrunk > rules.host_rate)


def quality_report(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    id_column: str = "doc_id",
    rules: QualityRules = QualityRules(),
) -> DataFrame:
    """One row per document with its counts, its host's verdict and ``kept``."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text"))
    counts = cut(_counts(slim, "text", rules).drop("text"))
    verdicts = host_verdicts(counts, "source", rules).select("host", "host_failed")
    joined = counts.join(verdicts, counts["source"].eqNullSafe(verdicts["host"]), "left")
    dropped = F.col("base_failed") | (F.col("host_failed") & (F.col("n_failures") > 0))
    return joined.withColumn("kept", ~dropped).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_failures", "host_failed",
    )
