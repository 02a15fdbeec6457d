"""Sharding by sampled splitters [native: DataFrame functions only].

Records are ordered by (hash of the text, hash of the id, id), so equal texts stand together. A sample
drawn with chances in proportion to size gives quantile boundaries; a hash that the quantiles repeat,
as that of a large group of copies, gets a range of its own. Ranges above their share are subdivided
by the hash of the id. Only ranges, never records, are summed in one place; the byte at which a
record stands in the whole order then decides its shard, so sizes differ by no more than one record.

Defined cases: a null text has no bytes and the CRC of nothing; repeated rows are rows of their own
and get slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.durable import cut

#: Bits of the text's hash that name the bucket in which its splitters are looked up.
BUCKET_BITS = 12


def _splitters(sample: list[int], ranges: int) -> list[int]:
    """Lower ends of the ranges: quantiles of the sampled keys. A key that fills a range on its own
    comes back as two ends, its own and the next, so that nothing else shares its range."""
    sample = sorted(sample)
    picked = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    ends = set(picked)
    ends.update(k + 1 for a, k in zip(picked, picked[1:]) if a == k and k < 2**63 - 1)
    return sorted(ends)


def shard(
    docs: DataFrame,
    shards: int = 40,
    text: str = "text",
    id_column: str = "doc_id",
    ranges_per_shard: int = 8,
    sample_per_range: int = 16,
    rows_per_range: int = 4_000_000,
) -> DataFrame:
    """One row per record: size, CRC, shard and slot. Law ``bytes``: shard sizes are near equal."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(data) + 16).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.xxhash64(data).alias("_key"),
            F.xxhash64(F.col(id_column).cast("string")).alias("_tie"),
        )
    )
    n_rows, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    ranges = max(shards * ranges_per_shard, -(-n_rows // rows_per_range))
    share = max(1, total // ranges)

    # The sample: about ranges * sample_per_range keys, each drawn by chance in proportion to its size.
    chance = F.col("size") * (ranges * sample_per_range / max(1, total))
    draw = F.pmod(F.xxhash64("_tie", "_key", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = [r[0] for r in rows.where(draw < chance).select("_key").collect()]
    ends = _splitters(sample, ranges)

    # Splitters are found by the first bits of the key: their buckets hold one or a few each.
    buckets: dict[int, list[int]] = {}
    for e in ends:
        buckets.setdefault(e >> (64 - BUCKET_BITS), []).append(e)
    table = [(b, bisect_left(ends, es[0]), es) for b, es in sorted(buckets.items())]
    edges = [-(1 << (BUCKET_BITS - 1)) + i for i in range(1 << BUCKET_BITS)]
    known = {b: (n, es) for b, n, es in table}
    full, before = [], 0
    for b in edges:
        n, es = known.get(b, (before, []))
        full.append((b, n, es))
        before = n + len(es)
    spark = docs.sparkSession
    lookup = spark.createDataFrame(full, "_bucket int, _before int, _ends array<long>")
    placed = (
        rows.withColumn("_bucket", F.shiftright("_key", 64 - BUCKET_BITS).cast("int"))
        .join(F.broadcast(lookup), "_bucket")  # 4096 rows; its ends are the splitters, `ranges` at most twice
        .withColumn("_range", F.col("_before") + F.size(F.filter("_ends", lambda e: e <= F.col("_key"))))
        .drop("_bucket", "_before", "_ends")
    )

    # Overfull ranges are subdivided: a single key by the id, others by the key, so copies stay together.
    filled = placed.groupBy("_range").agg(
        F.sum("size").alias("_bytes"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")
    )
    parts = filled.where(F.col("_bytes") > 2 * share).select(
        "_range",
        F.ceil(F.col("_bytes") / F.lit(share)).cast("int").alias("_n"),
        (F.col("_lo") == F.col("_hi")).alias("_single"),
    )
    # At most one row per range.
    placed = placed.join(F.broadcast(parts), "_range", "left").withColumn(
        "_sub",
        F.when(F.col("_n").isNull(), 0)
        .when(F.col("_single"), F.pmod(F.col("_tie"), F.col("_n")))
        .otherwise(F.pmod(F.xxhash64("_key", F.lit(11)), F.col("_n")))
        .cast("int"),
    )

    # Prefix sums over the ranges, not over records.
    sums = placed.groupBy("_range", "_sub").agg(F.sum("size").alias("_b"), F.count("*").alias("_c"))
    before_range = Window.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_range",
        "_sub",
        F.coalesce(F.sum("_b").over(before_range), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_c").over(before_range), F.lit(0)).alias("_row0"),
    )
    inside = Window.partitionBy("_range", "_sub").orderBy("_key", "_tie", "doc_id")
    ranked = (
        placed.withColumns(
            {
                "_b1": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                "_r1": F.row_number().over(inside),
            }
        )
        .join(F.broadcast(starts), ["_range", "_sub"])  # one row per range and part
        .withColumn("_mid", F.col("_byte0") + F.col("_b1") - F.col("size") / 2)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("_mid") * shards / max(1, total))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_row0") + F.col("_r1") - 1).alias("_rank"))
    )
    ranked = cut(ranked)
    first = ranked.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return ranked.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
