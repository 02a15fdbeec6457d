"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernel.llm.durable import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.durable import shared_path
    from quernel.llm.token_output import sequence_digests, write_packed

    return sequence_digests(write_packed(read(spark, sf_dir, "documents"), shared_path(spark, "packed")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.language_id import identify

    return identify(read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.pii import find

    return find(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.sharding import shard

    return shard(read(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.ngram_join import components

    return components(read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.lm_score import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.quality_rules import quality_report

    return quality_report(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.conversation_repair import repair

    return repair(read(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.divergence import audit

    return audit(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """What is counts, sums and a recursion over rows. The other queries are held against brute force, round trips and
    planted cases in ``tests/llm``."""
    from quernel.llm.oracle import DIVERGENCE_SQL, QUALITY_SQL, REPAIR_SQL

    return {"op9_quality_rules": QUALITY_SQL, "op11_conversation_repair": REPAIR_SQL, "op13_source_divergence": DIVERGENCE_SQL}
