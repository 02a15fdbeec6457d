"""The stages of the pipeline, against brute force."""

import zlib

import corpus_pipeline
from corpus_pipeline import drop_near_copies


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_copies_go_at_their_limit(spark, make, words):
    rows = []
    for g, n in enumerate((228, 229, 230, 240, 400)):
        base = words(1000 * g, n).split()
        for edits in (0, 5, 8):
            other = [f"z{g}x{edits}y{i}" if edits and i % (n // (edits + 1)) == 20 and i // (n // (edits + 1)) < edits else w for i, w in enumerate(base)]
            rows.append((len(rows), " ".join(other)))
    sets = {i: shingles(t) for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert (3, 4) in near and (0, 1) not in near
    up = {i: i for i in sets}
    for _ in sets:
        for a, b in near:
            up[a] = up[b] = min(up[a], up[b])
    kept = drop_near_copies(spark, make(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(up.values()))


def test_run_keeps_what_each_stage_keeps(spark, make, words, tmp_path):
    """A small corpus whose fate is known: every stage takes what it should and leaves the rest alone."""
    prose = {"en": "the of and that with this from have were been", "de": "der die und das mit von nicht auch eine sind"}
    item = "a farmer had seven cows and nine goats and sold them all at the market before the long winter came to the valley"

    def text(i, n=60, g="en"):
        return " ".join(f"{(prose[g] + ' ').split()[(i * 7 + k * k) % 10]}{chr(97 + (i + k) % 26)}{chr(97 + (i * k) % 26)}" if k % 3 else (prose[g].split())[(i + k) % 10] for k in range(n))

    rows = [(i, text(i, g="de" if i % 2 else "en"), "de" if i % 2 else "en", "s") for i in range(40)]
    rows += [
        (100, text(3, g="de"), "de", "s"), (101, text(4) + " more", "en", "s"), (102, text(50) + " " + item, "en", "s"), (103, text(60) + " write to ann.lee@mail.example.com", "en", "s"),
        (104, None, "en", "s"), (105, "12 34 !", None, None), (106, "", "de", "s"), (7, text(7, g="de"), "de", "s"), (107, text(70, 1500), "en", "s"), (None, text(80), "en", "s"),
    ]
    docs = make(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        state = stage(spark, state, str(tmp_path))
        assert state.columns == docs.columns and state.schema == docs.schema
        state.write.parquet(f"{tmp_path}/{k}.parquet")
        state = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        kept[k] = sorted(r.doc_id if r.doc_id is not None else -1 for r in state.select("doc_id").collect())
    every = sorted(-1 if r[0] is None else r[0] for r in rows)
    assert kept[0] == [i for i in every if i not in (104, 105, 106)]
    assert kept[1] == sorted(set(kept[0]) - {100, 101})
    assert kept[2] == kept[3] == [i for i in kept[1] if i != 102]
    clean = {r.doc_id: r.text for r in state.collect()}
    assert clean[103].endswith("write to [EMAIL]") and all(t == next(x[1] for x in rows if x[0] == i) for i, t in clean.items() if i != 103)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    from quernel.llm.tokens import default_vocabulary

    coder = Tokenizer.from_file(default_vocabulary())
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in packed}) == kept[3]
    for r in packed:
        ids = coder.encode(clean[r.doc_id], add_special_tokens=False).ids + [0]
        part = b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part)


def test_run_of_empty_tables(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
