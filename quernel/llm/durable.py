"""Cutting lineage where lost executors cannot hurt, and reading the inputs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of an Arrow batch, about: a worker holds a small multiple of it.
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python in batches bounded by bytes and not by their number alone."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(name, f"{BATCH_BYTES}b")
    return df


def release() -> None:
    """Gives freed memory back to the system: workers live on between tasks and stages, and what their allocators keep
    adds up beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which a worker keeps nothing that is free."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def _shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in ``spark.checkpoint.dir``. Only where that is unset
    and all runs on one machine, as in tests, a temporary folder is used."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quernel-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that all executors share and go on from there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Cuts for loops: tables written to the shared folder and read again.

    A checkpoint hands on the size estimate of its plan, and a join multiplies those of its sides. In a loop that
    joins tables with what became of them, the estimates would have twice the digits each round; files have a size.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_path(spark, "rounds")
        self.old: list[str] = []
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        self.old.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, keep: int) -> None:
        """Deletes all tables but the last ``keep``."""
        for path in self.old[:-keep]:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.old = self.old[-keep:]


def broadcast_if_small(df: DataFrame, rows: int = 500_000, width: Column | None = None, most: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``most`` bytes, else as it is. ``width`` is the
    size of a row; without it rows have to be of a few bytes."""
    total = F.lit(0) if width is None else F.sum(width)
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(total, F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
