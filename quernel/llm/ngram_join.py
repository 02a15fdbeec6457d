"""N-gram Jaccard join with a prefix tree.

Documents are sets of word n-grams, each a 64-bit hash. Equal sets are one node. In a global order of
the n-grams (frequent ones last, else by hash), two sets as similar as asked for share an n-gram in
their prefixes, so prefixes are shuffled by n-gram and meet there. Pairs from short lists are tested
against a lower bound of their difference (the parities of hashed members, exact in what it rejects);
long lists are chained in order of size instead of paired. What remains connects candidates into
groups, and each group's sets are joined in a prefix tree.

Groups too large for a task are split into blocks. First each block is joined for itself, together with
some sets of the group that all its blocks get: in a group of near copies nearly all sets link with one
of these, so they come out as one part. Then only sets outside the largest part are joined with every
block, and only these are copied. No task grows with a group, and a group of near copies costs about
its own size; in the worst case, a large group of unlike sets, it is all pairs of its blocks.

No link between different sets is lost: every step before the tree only rejects what cannot be similar.
Words, n-grams and sets are told apart by 64-bit hashes: two of n have the same with a chance of about
n * n / 2**65, whatever their letters are.

Defined cases: a document without words or text has the empty set and links with nothing; one with
fewer words than n has its whole sequence as its only n-gram; copies share one node; a null id is
never the smallest of its component (but where all are null); repeated rows get a row each; an empty
table gives an empty result; other columns are ignored by ``components`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.arrays import mix, text_chunks, word_hashes
from quernel.llm.components import connected
from quernel.llm.durable import broadcast_if_small, cut, fresh, in_batches, tidy
from quernel.llm.prefix_tree import links


@dataclass(frozen=True)
class JoinParams:
    n: int = 4
    #: Similarity asked for, in percent.
    percent: int = 85
    #: Lists of documents that share a prefix n-gram are paired up to this length, chained beyond it.
    pair_list: int = 32
    #: Share of the n-grams, those of the lowest hashes, whose document counts decide which are frequent.
    counted: float = 0.3
    #: Frequent n-grams that the order puts last, at most (8 bytes each, broadcast). Any order is right.
    frequent: int = 500_000
    #: Members of sets that one task joins, about.
    block: int = 400_000
    #: Sets of a large group that all its blocks get.
    pivots: int = 8
    #: Documents that are found again by a broadcast of their ids; more are found by a shuffle.
    broadcast_ids: int = 200_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row of a chunk its set: distinct hashes, ascending."""
    words, rows = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        h = mix(words + np.uint64(n))
        out = []
        m = len(words)
        grams = h[: max(0, m - n + 1)].copy()
        for j in range(1, n):
            grams = mix(grams) * np.uint64(0x9E3779B97F4A7C15) + h[j : m - n + 1 + j] if m >= n else grams
        grams = mix(grams)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for w in h[a:b]:
                    whole = mix(np.array([whole]))[0] * np.uint64(0xD1B54A32D192ED03) + w
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def node_of(members: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        h = mix(members ^ np.uint64(0xA0761D6478BD642F))
        both = np.array([h.sum(dtype=np.uint64) + np.uint64(len(members)), np.bitwise_xor.reduce(h)], np.uint64)
        return int(mix(mix(both[:1]) ^ both[1:]).view(np.int64)[0])


def _parities(members: np.ndarray) -> bytes:
    """The parity of the members in each of about as many places as there are members."""
    places = min(1 << 16, max(64, 1 << (len(members) - 1).bit_length()))
    hit = np.bincount((members & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(hit.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of members in just one of the sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # places of the larger one are folded
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


# --- frequent n-grams


def _deltas(values: np.ndarray) -> bytes:
    """Ascending distinct values below 2**48, in 4 bytes each where that is enough."""
    d = np.diff(values, prepend=np.uint64(0))
    if len(d) > 1 and d[1:].max() < 2**32:
        return b"d" + values[:1].tobytes() + d[1:].astype("<u4").tobytes()
    return b"r" + values.astype("<u8").tobytes()


def _undeltas(data: bytes) -> np.ndarray:
    if data[:1] == b"r":
        return np.frombuffer(data, "<u8", offset=1)
    first = np.frombuffer(data, "<u8", 1, 1)
    return np.concatenate((first, first + np.cumsum(np.frombuffer(data, "<u4", offset=9), dtype=np.uint64)))


def frequent_ngrams(docs: DataFrame, params: JoinParams, tasks: int) -> np.ndarray:
    """The most frequent n-grams (upper 48 bits) of more than ``pair_list`` documents, ascending."""
    bound = np.uint64(int(params.counted * 2**48))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            part = (values * np.uint64(tasks) // bound).astype(np.int64)
            edges = np.searchsorted(part, np.arange(tasks + 1))
            some = np.flatnonzero(np.diff(edges))
            counts = np.minimum(n, 65535).astype("<u2")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)),
                    pa.array([_deltas(values[edges[p] : edges[p + 1]]) for p in some], pa.binary()),
                    pa.array([counts[edges[p] : edges[p + 1]].tobytes() for p in some], pa.binary()),
                ],
                names=["part", "grams", "counts"],
            )

        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                for s in shingle_sets(data, offsets, params.n):
                    s = s >> np.uint64(16)
                    s = s[: np.searchsorted(s, bound)]
                    held.append(s)
                    size += len(s)
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = [], []
        for batch in batches:
            values += [_undeltas(x) for x in batch.column(1).to_pylist()]
            counts += [np.frombuffer(x, "<u2") for x in batch.column(2).to_pylist()]
        if values:
            v, n = np.concatenate(values), np.concatenate(counts).astype(np.int64)
            order = np.argsort(v)
            v, n = v[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            n = np.add.reduceat(n, first)
            often = n > params.pair_list
            yield pa.RecordBatch.from_arrays([pa.array(v[first][often].astype(np.int64)), pa.array(n[often])], names=["gram", "n"])

    rows = cut(
        docs.select("text").mapInArrow(tidy(emit), "part int, grams binary, counts binary").repartition(tasks, "part")
        .mapInArrow(tidy(merge), "gram long, n long")
    )
    by_size = {r[0]: r[1] for r in rows.groupBy(F.floor(F.log2("n"))).count().collect()}  # 64 rows at most
    taken, least = 0, 64
    while least > 0 and taken + by_size.get(least - 1, 0) <= params.frequent:
        least -= 1
        taken += by_size.get(least, 0)
    found = rows.where(F.floor(F.log2("n")) >= least).select("gram").toArrow().column(0)
    return np.sort(found.to_numpy().astype(np.uint64))


# --- candidates


def _described(docs: DataFrame, frequent: np.ndarray, params: JoinParams) -> DataFrame:
    """Per document (doc_id, print, text) its node, size, parities and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(2)):
                nodes, sizes, parities, prefixes = [], [], [], []
                for s in shingle_sets(data, offsets, params.n):
                    sizes.append(len(s))
                    if not len(s):
                        nodes.append(None), parities.append(None), prefixes.append(None)
                        continue
                    nodes.append(node_of(s))
                    parities.append(_parities(s))
                    keep = len(s) - (len(s) * params.percent + 99) // 100 + 1
                    if len(often):
                        upper = s >> np.uint64(16)
                        late = often[np.minimum(np.searchsorted(often, upper), len(often) - 1)] == upper
                        s = np.concatenate((s[~late], s[late]))
                    prefixes.append(s[:keep].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(first, len(sizes)) for c in (0, 1)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array(parities, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "print", "node", "n", "parities", "prefix"],
                )

    return docs.mapInArrow(tidy(run), "doc_id long, print long, node long, n long, parities binary, prefix array<long>")


def _pairs(params: JoinParams):
    """Streams lists of (token, n, node), sorted so, into pairs and chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, n, node = (np.zeros(0, np.int64) for _ in range(3))
        chained = False  # whether the first list held is known to be long

        def out(k: int, last: bool) -> pa.RecordBatch:
            t, m, v = token[:k], n[:k], node[:k]
            new = np.concatenate(([True], t[1:] != t[:-1])) if k else np.zeros(0, bool)
            run_no = np.cumsum(new) - 1
            length = np.bincount(run_no, minlength=1)
            long = length > params.pair_list
            if k and chained:
                long[0] = True
            long = long[run_no] if k else np.zeros(0, bool)
            a, b, hot = [], [], []
            for d in range(1, params.pair_list):
                same = (t[d:] == t[:-d]) & (m[:-d] * 100 >= m[d:] * params.percent)
                if not (t[d:] == t[:-d]).any():
                    break
                i = np.flatnonzero(same & ~long[:-d])
                a.append(v[i]), b.append(v[i + d]), hot.append(np.zeros(len(i), bool))
                if d == 1:
                    i = np.flatnonzero(same & long[:-1])
                    a.append(v[i]), b.append(v[i + 1]), hot.append(np.ones(len(i), bool))
            x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
            h = np.concatenate(hot) if hot else np.zeros(0, bool)
            x, y = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((h, y, x))
            x, y, h = x[order], y[order], h[order]
            keep = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (h[1:] != h[:-1]))) if len(x) else np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep]), pa.array(h[keep])], names=["a", "b", "hot"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            token, n, node = (np.concatenate(z) for z in zip((token, n, node), columns))
            if len(token) < 100_000:
                continue
            start = int(np.searchsorted(token, token[-1]))  # of the list that may go on
            if len(token) - start > params.pair_list or (start == 0 and chained):
                yield out(len(token), False)
                token, n, node, chained = token[-1:], n[-1:], node[-1:], True
            else:
                yield out(start, False)
                token, n, node, chained = token[start:], n[start:], node[start:], False
        if len(token):
            yield out(len(token), True)

    return run


def _possible(params: JoinParams):
    """Keeps pairs (a, b, na, nb, pa, pb) whose parities do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            most = [(p + q) * (100 - params.percent) / (100 + params.percent) for p, q in zip(na, nb)]
            ok = pa.array([least_difference(p, q) <= k for p, q, k in zip(x, y, most)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return run


# --- the tree join


def _tree_join(table: pa.Table, percent: int) -> pa.Table:
    """The links of some groups or blocks: rows (comp, i, node, probe, members). Sets of a block are joined with
    its sets marked ``probe``."""
    a, b = [], []
    order = table.sort_by([("comp", "ascending"), ("i", "ascending"), ("node", "ascending"), ("probe", "descending")])
    keys = np.stack([order.column(c).to_numpy() for c in ("comp", "i")], 1)
    nodes, probe = order.column("node").to_numpy(), order.column("probe").to_numpy(zero_copy_only=False)
    members = order.column("members")
    edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
    for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()):
        distinct = [k for k in range(p, q) if k == p or nodes[k] != nodes[k - 1]]
        asked = [at for at, k in enumerate(distinct) if probe[k]]
        if len(distinct) > 1 and asked:
            sets = [np.frombuffer(members[k].as_py(), np.uint64) for k in distinct]
            for i, j in links(sets, percent, asked):
                a.append(int(nodes[distinct[i]]))
                b.append(int(nodes[distinct[j]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _joined(rows: DataFrame, key: Column, params: JoinParams) -> DataFrame:
    """(a, b) of the blocks of ``rows`` (comp, i, node, probe, members); blocks of a key share a task."""
    keyed = rows.select(key.alias("_key"), "comp", "i", "node", "probe", "members")
    return keyed.groupBy("_key").applyInArrow(lambda t: _tree_join(t, params.percent), "a long, b long")


def _large_links(sets: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b): links of groups of several blocks. ``sets`` is a cut table (node, comp, _total, members)."""
    blocks = F.ceil(F.col("_total") / params.block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    key = F.xxhash64("comp", "i")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    # The pivots are drawn by a hash, so large parts of a group have some. The limit by partitions comes first.
    draw = Window.partitionBy("comp").orderBy(F.xxhash64("node", F.lit(5)), "node")
    few = sets.select("node", "comp").withColumn("_k", F.row_number().over(draw)).where(F.col("_k") <= params.pivots).select("node")
    shared = sets.join(broadcast_if_small(few), "node", "left_semi").select("comp", every.alias("i"), "node", F.lit(True).alias("probe"), "members")
    at_home = sets.select("comp", own.alias("i"), "node", F.lit(True).alias("probe"), "members")
    first = cut(_joined(at_home.unionByName(shared), key, params))
    parts = connected(first).withColumnRenamed("root", "_part")
    labelled = sets.select("node", "comp").join(parts, "node", "left").withColumn("_part", F.coalesce("_part", "node"))
    sizes = labelled.groupBy("comp", "_part").agg(F.count("*").alias("_n"))
    largest = sizes.groupBy("comp").agg(F.max_by("_part", F.struct("_n", "_part")).alias("_part"))
    rest = cut(labelled.join(largest, ["comp", "_part"], "left_anti").select("node"))
    if rest.isEmpty():
        return first
    outside = cut(sets.join(broadcast_if_small(rest), "node", "left_semi"))
    # Of a group much of which is outside, the outside is cut into pieces as well.
    weight = outside.groupBy("comp").agg(F.sum(F.octet_length("members") / 8).alias("_outside"))
    pieces = F.ceil(F.col("_outside") / params.block).cast("int")
    piece = F.pmod(F.xxhash64("node", F.lit(9)), pieces).cast("int")
    weight = cut(weight)
    n = F.col("_pieces")
    asking = outside.join(broadcast_if_small(weight), "comp").select(
        "comp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_b"), piece.alias("_p"), pieces.alias("_pieces"), "node", F.lit(True).alias("probe"), "members"
    )
    asked = sets.join(broadcast_if_small(weight), "comp").select(
        "comp", own.alias("_b"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_p"), pieces.alias("_pieces"), "node", F.lit(False).alias("probe"), "members"
    )
    both = asking.unionByName(asked).withColumn("i", (F.col("_b") * n + F.col("_p")).cast("int"))
    return first.unionByName(_joined(both, key, params))


def _links(docs: DataFrame, described: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b): links of nodes that connect all that similar sets connect."""
    nodes = described.where("node is not null").dropDuplicates(["node"])
    postings = nodes.select(F.explode("prefix").alias("token"), "n", "node")
    found = (
        postings.repartition("token").sortWithinPartitions("token", "n", "node")
        .mapInArrow(tidy(_pairs(params)), "a long, b long, hot boolean").where("a <> b").distinct()
    )
    found = cut(found)
    side = nodes.select("node", "n", "parities")
    pairs = (
        found.where("not hot").select("a", "b")
        .join(side.toDF("a", "na", "pa"), "a").join(side.toDF("b", "nb", "pb"), "b")
        .select("a", "b", "na", "nb", "pa", "pb").mapInArrow(tidy(_possible(params)), "a long, b long")
    )
    groups = connected(pairs.unionByName(found.where("hot").select("a", "b")))

    # One document of each candidate node gives its set.
    members = cut(groups.join(nodes.select("node", "n", F.col("doc_id").alias("_id")), "node").select("node", "root", "n", "_id"))
    total = members.groupBy("root").agg(F.sum("n").alias("_total"))
    needed = members.join(total, "root").withColumnRenamed("root", "comp")
    few = members.count() <= params.broadcast_ids
    is_small = F.col("_total") <= params.block

    def rows(some: Column) -> DataFrame:
        part = needed.where(some)
        found = docs.join(F.broadcast(part) if few else part, F.col("doc_id").eqNullSafe(F.col("_id")))
        return in_batches(found.select("text", "node", "comp", "_total")).mapInArrow(tidy(sets), "node long, comp long, _total long, members binary")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(0)):
                got = shingle_sets(data, offsets, params.n)
                part = batch.slice(first, len(got))
                # Rows of the same id may hold other texts.
                same = [k for k, s in enumerate(got) if len(s) and node_of(s) == part.column(1)[k].as_py()]
                at = pa.array(same, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in (1, 2, 3)), pa.array([got[k].tobytes() for k in same], pa.binary())],
                    names=["node", "comp", "_total", "members"],
                )

    everything = members.agg(F.sum("n")).first()[0] or 0
    # Small groups share a task, as many as fill a block.
    tasks = max(64, everything * 2 // params.block)
    small = rows(is_small).select("comp", F.lit(0).alias("i"), "node", F.lit(True).alias("probe"), "members")
    out = _joined(small, F.pmod(F.xxhash64("comp"), F.lit(tasks)), params)
    if total.where(~is_small).isEmpty():
        return out
    return out.unionByName(_large_links(cut(rows(~is_small)), params))


def _components(docs: DataFrame, text: str, id_column: str, params: JoinParams) -> DataFrame:
    """Per row (doc_id, print, n_shingles, _least): the hash of its text, and (doc_id, print) of the first row of its
    component; null for a row without words, and where no row of the component has an id."""
    slim = in_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    tasks = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frequent = frequent_ngrams(slim, params, tasks)
    described = cut(_described(slim, frequent, params))
    roots = connected(_links(slim, described, params)).select(F.col("node"), F.col("root").alias("_root"))
    rows = described.select("doc_id", "print", "n", "node").join(roots, "node", "left")
    rows = rows.select("doc_id", "print", F.col("n").alias("n_shingles"), F.coalesce("_root", "node").alias("_root"))
    # Cut, so that the join below shuffles both sides as they are and a hot root can be split.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "print")))
    least = cut(rows.where("_root is not null").groupBy("_root").agg(first.alias("_least")))
    return rows.join(least, "_root", "left").drop("_root")


def components(docs: DataFrame, text: str = "text", id_column: str = "doc_id", params: JoinParams = JoinParams()) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id reachable by links."""
    found = _components(docs, text, id_column, params)
    return found.select("doc_id", "n_shingles", F.coalesce("_least.doc_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Rows of one id with different texts are documents of their own: each stays or goes with its component, and
    of several in one component the one with the smallest hash of its text stays. Of rows alike in id and text one
    stays, whichever comes first. Rows without an id all stay.
    """
    mark, print_ = fresh(docs, "_other"), fresh(docs, "_print")
    found = _components(docs, "text", "doc_id", params).where("doc_id is not null and _least is not null")
    gone = found.where("struct(doc_id, print) <> _least").select(F.col("doc_id").alias(mark), F.col("print").alias(print_)).distinct()
    gone = broadcast_if_small(cut(gone))
    kept = docs.join(gone, (docs["doc_id"] == F.col(mark)) & (F.xxhash64(docs["text"]) == F.col(print_)), "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(mark)).where(F.col(mark) > 1)
    twice = cut(twice.select(F.col("doc_id").alias(mark)))
    if twice.isEmpty():
        return kept
    marked = kept.join(broadcast_if_small(twice), kept["doc_id"] == F.col(mark), "left")
    same = marked.where(F.col(mark).isNotNull()).withColumn(print_, F.sha2(F.coalesce("text", F.lit("")), 256))
    first = same.dropDuplicates(["doc_id", print_]).drop(print_)
    return marked.where(F.col(mark).isNull()).unionByName(first).drop(mark)
