"""Byte-pair operators against the tokenizers library, packing against its own conditions and a lower bound."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, packing, token_count, vocab

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def library_ids(path, texts):
    t = tokenizers.Tokenizer.from_file(path)
    return t, [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encode_decode_equals_library(frame, texts):
    t, want = library_ids(WORD, [x for _, x in texts])
    rows = frame(texts).select("doc_id", bpe.round_trip(F.col("text"), WORD).alias("r"), "n_tokens").collect()
    assert len(rows) == len(texts) and all(r["n_tokens"] == "mine" for r in rows)
    for r in rows:
        ids = np.frombuffer(r["r"]["ids"], "<u4").tolist()
        assert ids == want[r["doc_id"]]
        assert r["r"]["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_encode_then_decode_columns(frame, texts):
    some = texts[:5]
    t, want = library_ids(WORD, [x for _, x in some])
    rows = frame(some).select("doc_id", bpe.decode(bpe.encode(F.col("text"), WORD), WORD).alias("d")).collect()
    assert all(r["d"] == t.decode(want[r["doc_id"]], skip_special_tokens=False) for r in rows)


def test_small_memo_changes_nothing(texts, monkeypatch):
    want = list(bpe.Encoder(WORD).encode([x for _, x in texts]))
    monkeypatch.setattr(vocab, "MEMO", 10)
    monkeypatch.setattr(bpe, "FLAT", 50)
    assert list(bpe.Encoder(WORD).encode([x for _, x in texts])) == want
    small = token_count.Counter(BYTE)
    assert [small.count(x or "") for _, x in texts] == [len(i) for i in library_ids(BYTE, [x for _, x in texts])[1]]


def test_workers_keep_nothing_of_ended_encodings(frame, texts):
    """What a task has learnt about words goes with it: the workers run other stages afterwards."""

    def kept(batches):
        import gc

        gc.collect()
        held = sum(len(e.memo) + len(e.words) for e in gc.get_objects() if type(e).__name__ == "Encoder")
        for _ in batches:
            yield pd.DataFrame({"held": [held]})

    docs = frame(texts).repartition(8)
    for column in (packing.pieces(F.col("text"), WORD), bpe.encode(F.col("text"), WORD), bpe.round_trip(F.col("text"), WORD)):
        assert len(docs.select(column.alias("c")).collect()) == len(texts)
        assert {r["held"] for r in docs.select("doc_id").mapInPandas(kept, "held long").collect()} == {0}


def test_counts_equal_library(frame, texts):
    want = [len(i) for i in library_ids(BYTE, [x for _, x in texts])[1]]
    got = {r["doc_id"]: r["c"] for r in frame(texts).select("doc_id", token_count.count_tokens(F.col("text"), BYTE).alias("c")).collect()}
    assert got == dict(enumerate(want))


def check_packing(rows, capacity=4096):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_whole_query(spark):
    from gaugeworks.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op1_best_fit_packing"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, ids in zip(docs, library_ids(WORD, [d["text"] for d in docs])[1], strict=True):
        ids = [*ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[d["doc_id"], k] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    used, least = check_packing(rows), -(-sum(r["length"] for r in rows) // 4096)
    assert used <= least + 2


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, [4097, 600, 2100, 50][seed], 5000).tolist())
    plan = packing.plan(dict(counts), 4096)
    filled, placed = np.zeros(plan.sequences, np.int64), Counter()
    for length, _, n, first, _ in plan.slots:
        filled[first : first + n] += length
        placed[length] += n
    assert placed == counts and filled.max() <= 4096 and filled.min() > 0


def test_pack_ties_repeats_and_empty(spark, frame):
    same = spark.createDataFrame([(1, 700)] * 200 + [(2, 4096), (3, 1)], "doc_id long, length long").withColumn("offset", F.lit("mine"))
    rows = packing.pack(same, order=("doc_id",)).collect()
    assert len(rows) == 202 and check_packing(rows) == 41
    none = packing.pack(same.limit(0), order=("doc_id",))
    assert none.count() == 0 and none.columns == ["doc_id", "length", "sequence_id", "offset"]


def test_pieces_of_null_and_long_texts(frame):
    df = frame([(1, None), (None, ""), (3, "word " * 9000)]).select("doc_id", F.explode(packing.pieces(F.col("text"), WORD, with_ids=True)).alias("p")).select("doc_id", "p.*")
    rows = df.collect()
    assert sorted(r["length"] for r in rows if r["doc_id"] != 3) == [1, 1]
    assert [(r["piece"], r["start"], r["length"]) for r in sorted(rows, key=lambda r: (r["doc_id"] or 0, r["piece"])) if r["doc_id"] == 3] == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
