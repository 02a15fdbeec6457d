"""Language-model scoring by deleted interpolation.

The model mixes the maximum-likelihood bigram and unigram with the uniform distribution. The mixture
weights depend on how often the context was seen (buckets by powers of two) and are learned by
expectation-maximisation on held-out counts: for the documents of one training fold each document's own
counts are deleted from the model before its tokens are predicted.

The counts are of all training documents, and no table of them is ever in one place. Documents are
packed into blocks (their words as numbers into the block's own vocabulary). Each block sends its
distinct words and bigrams, with their training counts, to the partitions that own these hashes; an
owner adds up what all blocks send and answers each block in the order in which it asked. So a block
has the corpus-wide counts of just what it holds. Lists are sorted hashes, stored as differences. A
block sends nothing to owners of which it has no word or bigram, so there are never more messages than
distinct words and bigrams of the blocks, however many owners and blocks there are.

Words and bigrams are told apart by 64-bit hashes: two of n have the same with a chance of about n * n / 2**65.

Defined cases: a null or empty text is its end token alone; a null id is no remainder, so the document
trains and is not held out; without training documents every word is unknown; repeated rows are
counted and scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.arrays import mix, text_chunks, word_hashes
from quernel.llm.durable import cut, in_batches, tidy

#: The hash of the end token, which also stands before the first word.
END = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class LmParams:
    folds: int = 5
    #: Remainder of the documents that don't train.
    held_out: int = 1
    #: Remainder of the training documents on which the weights are learned, their own counts deleted.
    deleted: int = 2
    #: Tokens of a block.
    block: int = 1_500_000
    #: Bytes of text for each owner of counts.
    bytes_per_owner: int = 8_000_000
    buckets: int = 24
    em_steps: int = 60


# --- coding of lists


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each, compressed; 255 stands for a count of 255 or more, given before all bytes."""
    big = counts[counts >= 255].astype("<u8")
    data = len(big).to_bytes(8, "little") + big.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack_counts(packed: bytes) -> np.ndarray:
    data = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, offset=8 + 8 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", n, 8).astype(np.int64)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, in as few bytes each as hold all but a hundredth of them; those follow whole."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    bits = np.sort(np.frexp(steps.astype(np.float64))[1])
    width = min(8, int(bits[len(bits) * 99 // 100]) // 8 + 1) if len(bits) else 1
    large = np.flatnonzero(steps >> np.uint64(8 * width)) if width < 8 else np.zeros(0, np.int64)
    low = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + len(large).to_bytes(8, "little") + large.astype("<u8").tobytes() + steps[large].tobytes() + low.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    low = np.frombuffer(data, np.uint8, offset=9 + 16 * n).reshape(-1, width)
    steps = np.zeros((len(low), 8), np.uint8)
    steps[:, :width] = low
    steps = steps.view("<u8").ravel()
    steps[np.frombuffer(data, "<u8", n, 9).astype(np.int64)] = np.frombuffer(data, "<u8", n, 9 + 8 * n)
    return np.cumsum(steps, dtype=np.uint64)


def _squeeze(ids: np.ndarray) -> bytes:
    """Small numbers byte by byte, lowest bytes first, compressed."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


# --- blocks

_BLOCK = "block long, deleted boolean, doc_ids array<long>, trains array<boolean>, held array<boolean>, lengths array<int>, words binary, ids binary"


def _blocks(params: LmParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (doc_id, text, trains, deleted, held) to blocks; deleted documents have blocks of their own."""
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        task, made = TaskContext.get(), 0

        def flush(kind: bool) -> pa.RecordBatch:
            nonlocal made
            names = [x for n, *_ in held[kind] for x in n]
            trains = np.concatenate([t for _, t, *_ in held[kind]])
            out = np.concatenate([o for _, _, o, _, _ in held[kind]])
            lengths = np.concatenate([n for *_, n, _ in held[kind]])
            keys, inverse, counts = np.unique(np.concatenate([h for *_, h in held[kind]]), return_inverse=True, return_counts=True)
            rank = np.empty(len(keys), np.int64)
            order = np.argsort(-counts, kind="stable")
            rank[order] = np.arange(len(keys))
            block = (task.partitionId() << 24) + made
            made += 1
            held[kind], size[kind] = [], 0
            row = [
                pa.array([block], pa.int64()), pa.array([kind], pa.bool_()), pa.array([names], pa.list_(pa.int64())),
                pa.array([trains], pa.list_(pa.bool_())), pa.array([out], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([keys[order].tobytes()], pa.binary()), pa.array([_squeeze(rank[inverse])], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, names=[x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            names = batch.column(0).to_pylist()
            trains, kinds, out = (np.array(batch.column(i).to_pylist(), bool) for i in (2, 3, 4))
            for first, data, offsets in text_chunks(batch.column(1)):
                words, rows = word_hashes(data, offsets)
                n = len(rows) - 1
                # The end token after the words of each row.
                tokens = np.full(len(words) + n, END, np.uint64)
                tokens[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(rows))] = words
                lengths = (np.diff(rows) + 1).astype(np.int32)
                here = slice(first, first + n)
                for kind in (False, True):
                    mine = kinds[here] == kind
                    if mine.any():
                        some = tokens[np.repeat(mine, lengths)]
                        held[kind].append(([x for x, m in zip(names[here], mine) if m], trains[here][mine], out[here][mine], lengths[mine], some))
                        size[kind] += len(some)
                        if size[kind] >= params.block:
                            yield flush(kind)
        for kind in (False, True):
            if held[kind]:
                yield flush(kind)

    return run


class Block:
    """A block with its words and bigrams as sorted keys; ``word``, ``before`` and ``pair`` are places in them."""

    def __init__(self, row: dict):
        self.lengths = np.array(row["lengths"], np.int64)
        keys = np.frombuffer(row["words"], np.uint64)
        ids = _unsqueeze(row["ids"], int(self.lengths.sum()))
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.words = keys[order]
        self.word = place[ids]
        self.trains = np.repeat(np.array(row["trains"], bool), self.lengths)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        # Every document ends with END, so the token before a first word is END as well.
        self.before = np.concatenate((self.word[-1:], self.word[:-1]))
        with np.errstate(over="ignore"):
            both = mix(mix(self.words[self.before]) * np.uint64(0xD6E8FEB86659FD93) + self.words[self.word])
        self.pairs, self.pair = np.unique(both, return_inverse=True)

    def lists(self, owners: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """For each owner that has any (its number, words, their training counts, pairs, theirs)."""
        n1 = np.bincount(self.word[self.trains], minlength=len(self.words))
        n2 = np.bincount(self.pair[self.trains], minlength=len(self.pairs))
        o1, o2 = _owner(self.words, owners), _owner(self.pairs, owners)
        some = np.union1d(o1, o2)
        starts, ends = (zip(np.searchsorted(o1, some, side), np.searchsorted(o2, some, side)) for side in ("left", "right"))
        for p, (a1, a2), (b1, b2) in zip(some.tolist(), starts, ends):
            a, b = slice(a1, b1), slice(a2, b2)
            yield p, pack_keys(self.words[a]), pack_counts(n1[a]), pack_keys(self.pairs[b]), pack_counts(n2[b])


def _owner(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners by equal ranges of the keys, so the answers of the owners in order are those of the keys in order."""
    return ((keys >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _ask(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lists = list(zip(*Block(row).lists(owners)))
                columns = [pa.array([row["block"]] * len(lists[0]), pa.int64()), pa.array(lists[0], pa.int32()), *(pa.array(x, pa.binary()) for x in lists[1:])]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "owner", "words", "n1", "pairs", "n2"])

    return run


_ANSWERS = pa.schema(
    [("block", pa.int64()), ("owner", pa.int32()), ("n1", pa.binary()), ("n2", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())]
)


def _answer(asked: pa.Table) -> pa.Table:
    """All lists of one owner to answers, and a row without a block with the owner's sums."""
    n = asked.num_rows
    answers, tokens, types = [], 0, 0
    for keys, counts in (("words", "n1"), ("pairs", "n2")):
        lists = [unpack_keys(x.as_py()) for x in asked.column(keys)]
        every, where = np.unique(np.concatenate(lists), return_inverse=True)
        ends = np.cumsum([len(x) for x in lists])
        del lists
        sums = np.bincount(where, np.concatenate([unpack_counts(x.as_py()) for x in asked.column(counts)]), len(every)).astype(np.int64)
        if keys == "words":
            tokens, types = int(sums.sum()), int((sums > 0).sum())
        answers.append([pack_counts(sums[w]) for w in np.split(where, ends[:-1])])
    owner = asked.column("owner")[0].as_py()
    columns = [asked.column("block").to_pylist() + [None], [owner] * (n + 1), *(a + [None] for a in answers), [None] * n + [tokens], [None] * n + [types]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ANSWERS)], schema=_ANSWERS)


def _counts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The answers of all owners to one block: counts of its words, counts of its pairs."""
    got = sorted(row["answers"], key=lambda a: a["owner"])
    return np.concatenate([unpack_counts(a["n1"]) for a in got]), np.concatenate([unpack_counts(a["n2"]) for a in got])


# --- weights


def _bucket(context: np.ndarray, buckets: int) -> np.ndarray:
    """0 for a context never seen, then by powers of two."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], buckets - 1)


#: Steps of a logarithm to base 2 in which the ratios of the components are counted.
STEP = 4


def _ratio_counts(tokens: int, types: int, params: LmParams):
    """Counts of (bucket, bigram and unigram against uniform) over the deleted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row)
                n1, n2 = _counts(row)

                def own(x: np.ndarray, width: int) -> np.ndarray:
                    """How often the token's own document has the same."""
                    _, where, n = np.unique(b.doc * width + x, return_inverse=True, return_counts=True)
                    return n[where]

                c1 = n1[b.before] - own(b.before, len(b.words))
                # Only what trains is in the counts.
                c2, c12 = n1[b.word] - own(b.word, len(b.words)), n2[b.pair] - own(b.pair, len(b.pairs))
                n = np.maximum(1, tokens - b.lengths[b.doc])
                with np.errstate(divide="ignore", invalid="ignore"):
                    r2 = np.where(c1 > 0, c12 / np.maximum(c1, 1), 0) * (types + 1)
                    r1 = c2 / n * (types + 1)
                    q2, q1 = (np.where(r > 0, np.round(np.log2(r) * STEP), -999).astype(np.int64) for r in (r2, r1))
                key = (_bucket(c1, params.buckets) * 4096 + q2 + 1000) * 4096 + q1 + 1000
                keys, count = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count)], names=["k", "n"])

    return run


def learn_weights(keys: np.ndarray, counts: np.ndarray, params: LmParams) -> np.ndarray:
    """Weights of bigram, unigram and uniform for each bucket, by expectation-maximisation."""
    weights = np.full((params.buckets, 3), 1 / 3)
    q1, rest = keys % 4096 - 1000, keys // 4096
    q2, bucket = rest % 4096 - 1000, rest // 4096
    r = np.stack([np.where(q == -999, 0, np.exp2(q / STEP)) for q in (q2, q1)] + [np.ones(len(keys))], 1)
    for _ in range(params.em_steps if len(keys) else 0):
        share = weights[bucket] * r
        share *= (counts / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], params.buckets) for k in range(3)], 1) + 1e-3
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0, 0] = 0  # nothing follows a context never seen
    return weights / weights.sum(axis=1, keepdims=True)


def _score(tokens: int, types: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row)
                n1, n2 = _counts(row)
                c, context = n1[b.word], n1[b.before]
                starts = np.cumsum(b.lengths) - b.lengths
                w = weights[_bucket(context, len(weights))]
                p = w[:, 0] * n2[b.pair] / np.maximum(context, 1) + w[:, 1] * c / max(tokens, 1) + w[:, 2] / (types + 1)
                base = np.log10((c + 0.5) / (tokens + 0.5 * (types + 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lengths),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array([tokens] * len(starts), pa.int64()),
                        pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame, text: str = "text", id_column: str = "doc_id", params: LmParams = LmParams()) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    rest = F.crc32(F.col(id_column).cast("string").cast("binary")) % params.folds
    is_held = F.coalesce(rest == params.held_out, F.lit(False))
    rows = in_batches(docs).select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), (~is_held).alias("trains"),
        F.coalesce(rest == params.deleted, F.lit(False)).alias("deleted"), is_held.alias("held"),
    )
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    owners = max(8, size // params.bytes_per_owner)
    blocks = cut(rows.mapInArrow(tidy(_blocks(params)), _BLOCK))
    asked = blocks.mapInArrow(tidy(_ask(owners)), "block long, owner int, words binary, n1 binary, pairs binary, n2 binary")
    kinds = "block long, owner int, n1 binary, n2 binary, tokens long, types long"
    answers = cut(asked.repartition(owners, "owner").groupBy("owner").applyInArrow(_answer, kinds))
    tokens, types = answers.where("block is null").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = tokens or 0, types or 0

    def answered(some: DataFrame) -> DataFrame:
        got = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("owner", "n1", "n2")).alias("answers"))
        return some.join(got, "block")

    ratios = (
        answered(blocks.where("deleted")).mapInArrow(tidy(_ratio_counts(tokens, types, params)), "k long, n long")
        .groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    )  # fmt: skip  # buckets times two ratios: some ten thousand rows, whatever the corpus
    weights = learn_weights(ratios.column("k").to_numpy(), ratios.column("n").to_numpy(), params)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered(blocks).mapInArrow(tidy(_score(tokens, types, weights)), out)
