"""Dense ranking: cosine search of a batch of query vectors over all vectors, and similar pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators.lexical import top

#: Vectors and query vectors that meet in a task, about.
BLOCK, QUERY_BLOCK = 16_384, 4096


def dot(a, b):
    """The inner product of two array columns in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(dot(a, a))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of one width, without nulls, as rows of length one (zero if they have none)."""
    flat = np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
    m = flat.reshape(-1, width)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v, width) of the vectors that have numbers only; null and empty ones match nothing."""
    v = F.col(vector).cast("array<double>")
    usable = vectors.where((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    return usable.select(key, v.alias("v"), F.size(vector).alias("width"))


def _blocks(df: DataFrame, key: str, size: int) -> tuple:
    """(number of blocks of about ``size`` rows, the block of a row)."""
    n = max(1, -(-df.count() // size))
    return n, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def vector_search(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6
) -> DataFrame:
    """(query_id, key, score, rank): the k most similar keys, the best of a key's chunks.

    Each query meets the vectors of its own width; null and empty vectors, and those with a null in them, match
    nothing. Blocks of queries meet blocks of vectors in tasks, one product each, and send on the best k of each query;
    the rest is a small top-k. All chunks of a key are in one block.
    """
    v, asked = _whole(vectors, key, vector), _whole(queries, "query_id", vector)
    (n, i), (m, j) = _blocks(v, key, BLOCK), _blocks(asked, "query_id", QUERY_BLOCK)
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = v.select(key, "v", "width", i.alias("i"), every(m).alias("j"))
    right = asked.select("query_id", "v", "width", every(n).alias("i"), j.alias("j"))

    def best(group: pa.Table, wanted: pa.Table) -> pa.Table:
        width = group.column("width")[0].as_py() if len(group) else 1
        keys, where = np.unique(np.asarray(group.column(key).to_pylist()), return_inverse=True)
        rows = np.argsort(where, kind="stable")
        heads = np.searchsorted(where[rows], np.arange(len(keys)))
        matrix = _matrix(group.column("v"), width)[rows] if len(group) else np.zeros((0, 1))
        names = wanted.column("query_id").to_pylist()
        out_q, out_k, out_s = [], [], []
        for at in range(0, len(names) if len(keys) else 0, 256):
            unit = _matrix(wanted.column("v").slice(at, 256), width)
            # Rounded before the cut, so ties go by key as in the end; the best chunk of each key.
            scores = np.maximum.reduceat(np.round(matrix @ unit.T, digits), heads, axis=0)
            order = np.argsort(-scores, axis=0, kind="stable")[:k]
            out_q.extend(np.repeat(np.arange(at, at + unit.shape[0])[None, :], len(order), 0).ravel().tolist())
            out_k.append(keys[order].ravel())
            out_s.append(np.take_along_axis(scores, order, 0).ravel())
        columns = [
            pa.array([names[x] for x in out_q], wanted.schema.field("query_id").type),
            pa.array(np.concatenate(out_k).tolist() if out_k else [], group.schema.field(key).type),
            pa.array(np.concatenate(out_s) if out_s else [], pa.float64()),
        ]
        return pa.Table.from_arrays(columns, names=["query_id", key, "score"])

    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString())
    met = left.groupBy("width", "i", "j").cogroup(right.groupBy("width", "i", "j"))
    parts = met.applyInArrow(best, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
    return top(parts.groupBy("query_id", key).agg(F.max("score").alias("score")), k, key, digits)


def similar_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(a, b, score) of all pairs of one width of at least ``least``, by blocks: a task multiplies two blocks of about
    ``block`` vectors. Keys are unique; null and empty vectors, and those with a null in them, are in no pair."""
    whole = _whole(vectors, key, vector)
    blocks, own = _blocks(whole, key, block)
    spread = (
        whole.select(key, "v", "width", own.alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(key, "v", "width", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        keys = np.asarray(table.column(key).to_pylist())
        own_, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
        m = _matrix(table.column("v"), table.column("width")[0].as_py())
        left, right = np.flatnonzero(own_ == i), np.flatnonzero(own_ == j)
        a, b, s = [], [], []
        for start in range(0, len(left), 1024):
            part = left[start : start + 1024]
            scores = m[part] @ m[right].T
            x, y = np.nonzero(scores >= least)
            p, r = keys[part[x]], keys[right[y]]
            keep = (p < r) if i[0] == j[0] else np.ones(len(p), bool)
            a.extend(np.where(p < r, p, r)[keep].tolist()), b.extend(np.where(p < r, r, p)[keep].tolist()), s.extend(scores[x, y][keep].tolist())
        kind = table.schema.field(key).type
        return pa.Table.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(s, pa.float64())], names=["a", "b", "score"])

    kind = vectors.schema[key].dataType.simpleString()
    return spread.groupBy("width", "i", "j").applyInArrow(join, f"a {kind}, b {kind}, score double")


def dispersion(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, n, mean_similarity): the mean cosine of all pairs within a group, without making them.

    Unit vectors of a group have n + 2 * (sum over pairs) as the square of their sum's norm, so a group needs its sum
    only. Every vector counts; one that is null, empty, of norm zero or holds a null has cosine zero with all, as have
    two of different widths. A group of fewer than two has zero.
    """
    whole = vectors.groupBy(group).agg(F.count("*").alias("n"))
    usable = vectors.where((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())).select(group, F.col(vector).cast("array<double>").alias("v"))
    unit = usable.withColumn("norm", norm(F.col("v"))).where("norm > 0").select(group, F.size("v").alias("width"), F.transform("v", lambda x: F.try_divide(x, F.col("norm"))).alias("u"))
    sums = unit.select(group, "width", F.posexplode("u").alias("at", "x")).groupBy(group, "width", "at").agg(F.sum("x").alias("x"), F.count("*").alias("m"))
    square = sums.groupBy(group, "width").agg((F.sum(F.col("x") * F.col("x")) - F.max("m")).alias("s")).groupBy(group).agg(F.sum("s").alias("s"))
    joined = whole.join(square.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left")
    mean = F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return joined.select(group, "n", mean.alias("mean_similarity"))


#: How much closer to each other rewrites may be than their sources, and how far one may be from its own.
CONVERGENCE_CEILING, FIDELITY_FLOOR = 0.05, 0.55


def rewrite_dispersion(rewrites: DataFrame, group: str, key: str, source: str, rewrite: str) -> DataFrame:
    """One row a group of rewritten notes (vectors of ``source`` and ``rewrite``): how close sources and rewrites are to
    each other, whether rewriting made them alike, and how close each is to its own source: mean, least, whose that
    is, and how many are below the floor."""
    own = F.try_divide(dot(F.col(source), F.col(rewrite)), norm(F.col(source)) * norm(F.col(rewrite)))
    own = F.coalesce(F.when(F.size(source) == F.size(rewrite), own), F.lit(0.0))
    fidelity = rewrites.select(group, key, own.alias("c")).groupBy(group).agg(
        F.avg("c").alias("mean_fidelity"), F.min("c").alias("min_fidelity"), F.min_by(key, F.struct("c", key)).alias("least_faithful"),
        F.count_if(F.col("c") < FIDELITY_FLOOR).alias("below_floor"))
    before = dispersion(rewrites, group, source).withColumnRenamed("mean_similarity", "source_convergence")
    after = dispersion(rewrites, group, rewrite).select(F.col(group).alias("_a"), F.col("mean_similarity").alias("rewrite_convergence"))
    found = before.join(after, F.col(group).eqNullSafe(F.col("_a"))).join(fidelity.withColumnRenamed(group, "_f"), F.col(group).eqNullSafe(F.col("_f")))
    delta = F.col("rewrite_convergence") - F.col("source_convergence")
    return found.select(group, "n", "source_convergence", "rewrite_convergence", delta.alias("delta"), (delta > CONVERGENCE_CEILING).alias("homogenised"),
                        "mean_fidelity", "min_fidelity", "least_faithful", "below_floor")
