"""Tokens, packing and sharding: exact round trips and invariants."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq

from quernel.llm import registry, tokens
from quernel.llm.packing import PackingParams, pack_documents, pack_histogram, place
from quernel.llm.sharding import shard
from quernel.llm.token_output import RoomTree, TokenOutputParams, best_fit_decreasing, packed_sequences, sequence_digests, write_packed
from quernel.llm.tokens import default_vocabulary, encoder

TEXTS = [None, "", "a", "Hello world's re'll  x\n\n y", "é漢字🙂 ½²", "word " * 3000, "<|endoftext|> in text", "a", "a"]


def expected_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_tokenizers():
    rnd = random.Random(1)
    parts = ["'s", "re", "'ll", " ", "  ", "\n", "\t", "Ab", "é", "ß", "23", "²", "!", "..", "　", "漢字", "🙂", "_", "'", "\x1c", "\x85", "Ⅷ", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(500)] + TEXTS
    got = []
    for _, ids, offsets in encoder(default_vocabulary()).encode(texts):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [expected_ids(t)[:-1] for t in texts]


def test_pieces_are_told_apart_by_their_letters(monkeypatch, alike):
    texts = [*alike, " ".join(alike), *TEXTS, "some other words, and 12 numbers", "some other words"]
    expected = [expected_ids(t)[:-1] for t in texts]
    exact = tokens.spans_hash
    for mask in (2**64 - 1, 15):
        monkeypatch.setattr(tokens, "spans_hash", lambda *a: exact(*a) & np.uint64(mask))
        coder = tokens.Encoder(default_vocabulary())
        for _ in range(2):
            got = [ids[a:b].tolist() for _, ids, offsets in coder.encode(texts) for a, b in zip(offsets[:-1], offsets[1:])]
            assert got == expected


def test_packing_round_trip(make, alike):
    rows = list(enumerate([*TEXTS, *alike])) + [(2, "a"), (50, None)]
    for params in (PackingParams(), PackingParams(sequence=16, rank_bucket=3)):
        got = [r.asDict() for r in pack_documents(make(rows), params=params, with_ids=True).collect()]
        by_doc: dict = {}
        for r in got:
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            by_doc.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
        for i, t in rows:
            ids, copies = expected_ids(t), sum(x[0] == i for x in rows)
            parts = sorted(by_doc[i], key=lambda p: p[0])[::copies]
            assert [x for _, p, _ in parts for x in p] == ids and all(n == len(ids) for *_, n in parts)
        sequences: dict = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for s in sequences.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= params.sequence
    assert pack_documents(make([])).collect() == []


def test_histogram_packing_pads_little():
    rnd = random.Random(2)
    counts: dict = {}
    for _ in range(50_000):
        n = min(1024, int(rnd.expovariate(1 / 300)) + 1)
        counts[n] = counts.get(n, 0) + 1
    slots = pack_histogram(counts, 1024)
    used = sum(n * c for n, c in counts.items())
    # The last sequence is that of the last block: its ranks go on to the end of the length.
    sequences = 1 + max(
        int(place(slots, np.array([n]), np.array([c - 1]), 1024)[0][0]) for n, c in counts.items()
    )
    assert used / 1024 / sequences > 0.99
    assert pack_histogram({}, 1024).length.size == 0


def test_best_fit_is_the_least_room():
    rnd = random.Random(3)
    tree, rooms = RoomTree(64), []
    for _ in range(500):
        if rooms and rnd.random() < 0.4:
            r = rooms.pop(rnd.randrange(len(rooms)))
            tree.add(r, -1)
        else:
            r = rnd.randrange(65)
            rooms.append(r)
            tree.add(r, 1)
        ask = rnd.randrange(65)
        assert tree.least(ask) == min((r for r in rooms if r >= ask), default=-1)
    assert best_fit_decreasing(np.array([], np.int64), 8) == []


def test_token_output(make, alike):
    rows = list(enumerate([*TEXTS, *alike])) + [(2, "a")]
    params = TokenOutputParams(sequence=32, block_tokens=200)
    found: dict = {}
    for r in packed_sequences(make(rows), params=params).collect():
        ids, where = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(where) == 32 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 32
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert where[a:b].tolist() == list(range(b - a))
            found.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for i, t in rows:
        copies = sum(x[0] == i for x in rows)
        assert [x for _, p in sorted(found[i], key=lambda p: p[0])[::copies] for x in p] == expected_ids(t)
    assert packed_sequences(make([])).collect() == []


def test_written_matrices_hold_all_documents(spark, make, tmp_path):
    """The files alone, read by another reader, give back every document."""
    rows = list(enumerate(TEXTS))
    path = str(tmp_path / "packed")
    table = write_packed(make(rows), path, params=TokenOutputParams(sequence=64, block_tokens=500))
    files = pq.read_table(path).to_pylist()
    assert len(files) == table.count() and all(len(r["input_ids"]) == len(r["position_ids"]) == 256 for r in files)
    found: dict = {}
    for r in files:
        ids, cu = np.frombuffer(r["input_ids"], "<u4"), r["cu_seqlens"]
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], cu, cu[1:]):
            found.setdefault(doc, []).append((start, ids[a:b].tolist()))
    assert {i: [x for _, p in sorted(found[i]) for x in p] for i in found} == {i: expected_ids(t) for i, t in rows}
    digests = {(d.first_doc_id, d.first_start): d for d in sequence_digests(table).collect()}
    for r in files:
        d = digests[r["first_doc_id"], r["first_start"]]
        assert (d.ids_crc32, d.positions_crc32, d.padding) == (zlib.crc32(r["input_ids"]), zlib.crc32(r["position_ids"]), 64 - r["n_tokens"])
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(r["n_tokens"] for r in registry.op2_token_output(spark, str(tmp_path)).collect()) == sum(len(expected_ids(t)) for _, t in rows)


def test_sharding(make):
    rnd = random.Random(4)
    texts = [None, "", "é" * 500] + [f"text {i} " * rnd.randrange(1, 60) for i in range(900)] + ["copy " * 30] * 500
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "x")]
    got = shard(make(rows), shards=8).collect()
    assert len(got) == len(rows)
    size, slots = {}, {}
    for r in got:
        t = texts[r.doc_id] if r.doc_id is not None else "x"
        data = (t or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(size) == list(range(8)) and max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Copies stand together: at most one more shard than their bytes need.
    assert len({r.shard for r in got if r.size == 166 and r.doc_id is not None and r.doc_id >= 903}) <= 5
    assert shard(make([])).collect() == []
