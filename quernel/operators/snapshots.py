"""A snapshot of notes and their links that a rebuild brings up to date by what is new, changed or gone.

The snapshot is one table on a shared folder, cut into buckets by the hash of the path. A rebuild reads the states of all
notes but the texts of the changed ones only, and overwrites the buckets that change and no others. It can be broken off
and repeated: what is already in place is no longer newer, so a second run of the same input writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import signals
from quernel.operators.loops import held

BUCKETS = 64
ROW = "path string, stem string, modified timestamp, gone boolean, links array<struct<target:string,kind:string>>, bucket int"


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, folder: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All states of a snapshot, those of notes that are gone too; empty if there is none yet."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).parquet(folder)


def nodes(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("NOT gone").select("path", "stem", "modified")


def edges(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("NOT gone").select("path", F.inline("links"))


def changes(notes: DataFrame, snapshot: DataFrame, whole: bool = True) -> DataFrame:
    """(path, change): notes that are new, or newer than the snapshot has them, and if ``notes`` is the ``whole`` corpus
    those that are gone. Of a path that comes twice the newest counts."""
    now = notes.groupBy("path").agg(F.max("modified").alias("modified"))
    old = snapshot.select("path", F.col("modified").alias("_old"), F.col("gone").alias("_gone"))
    both = now.withColumn("_here", F.lit(True)).join(old, "path", "full" if whole else "left")
    here, known = F.coalesce("_here", F.lit(False)), F.coalesce(~F.col("_gone"), F.lit(False))
    newer = F.coalesce(F.col("modified") > F.col("_old"), F.col("_old").isNull())
    change = F.when(here & ~known, "new").when(here & newer, "changed").when(~here & known, "gone")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def rebuild(notes: DataFrame, folder: str, whole: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Brings the snapshot in ``folder`` up to ``notes`` (path, stem, modified, raw); gives (path, change) of what it did.
    Without ``whole`` the notes are a batch, and no other note is touched."""
    spark = notes.sparkSession
    snapshot = read(spark, folder)
    todo, n = held(changes(notes, snapshot, whole))
    if not n:
        return todo
    latest = notes.join(todo.where("change <> 'gone'"), "path", "left_semi").groupBy("path").agg(F.max_by(F.struct("stem", "modified", "raw"), "modified").alias("_n"))
    latest = latest.select("path", "_n.*")
    links = signals.typed_edges(latest, "raw", "path").groupBy("path").agg(F.array_sort(F.collect_set(F.struct("target", F.col("edge_type").alias("kind")))).alias("links"))
    none = F.array().cast("array<struct<target:string,kind:string>>")
    fresh = latest.join(links, "path", "left").select("path", "stem", "modified", F.lit(False).alias("gone"), F.coalesce("links", none).alias("links"))
    gone = snapshot.join(todo.where("change = 'gone'"), "path", "left_semi").select("path", "stem", "modified", F.lit(True).alias("gone"), none.alias("links"))
    # At most one row for each bucket.
    touched = [r[0] for r in todo.select(_bucket(F.col("path"), buckets).alias("b")).distinct().collect()]
    kept = snapshot.where(F.col("bucket").isin(touched)).join(todo, "path", "left_anti").drop("bucket")
    rows = kept.unionByName(fresh).unionByName(gone).withColumn("bucket", _bucket(F.col("path"), buckets))
    rows, _ = held(rows, 0)  # what is overwritten is read before
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return todo
