import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

from ebbtide.llm import packing as K  # noqa: E402

PATH = public_tokenizers.path(K.VOCABULARY)
ORACLE = Tokenizer.from_file(PATH)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def encode(text):
    return ORACLE.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=40))
@settings(max_examples=400, deadline=None)
def test_chunks_give_the_library_its_ids(text):
    assert ids(K.encoder(PATH).encode(text.encode())) == encode(text)


def test_odd_texts_and_small_memos(monkeypatch):
    rng = random.Random(0)
    letters = " aBcZ\n\t́ͅéÅΣς1'’<|>漢가\x1c\x85İẛſK.,-"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(1500)] + ["<|endoftext|> x<|startoftext|>", "<|EndOfText|>", "İ İ. İ,", "H̱ ẖ", "don't I'LL x"]
    for limit in (K.MEMO_CHUNKS, 40):
        monkeypatch.setattr(K, "MEMO_CHUNKS", limit)
        monkeypatch.setattr(K, "RUN_CHUNKS", 7)
        tool = K.ChunkEncoder(PATH)
        for t in texts:
            assert ids(tool.encode(t.encode())) == encode(t), ascii(t)


def test_texts_without_chunks_keep_their_place_before_long_texts():
    long, longer = "word " * (K.RUN_CHUNKS + 1000), "Two words, " * K.RUN_CHUNKS
    for texts in (["", long], [long, "", longer, "e"], [" \n", "", long, " ", longer, ""], ["e", "", long]):
        got = [ids(x) for x in K.ChunkEncoder(PATH).encode_all(t.encode() for t in texts)]
        assert got == [encode(t) for t in texts]


def valid(lengths, sequence, offset, capacity):
    for s in set(sequence.tolist()):
        own = np.flatnonzero(sequence == s)
        order = own[np.argsort(offset[own])]
        assert offset[order].tolist() == [0, *np.cumsum(lengths[order])[:-1].tolist()]
        assert lengths[own].sum() <= capacity[0] and len(own) <= capacity[1] and np.square(lengths[own]).sum() <= capacity[2]


@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from(["norm", "dot"]), st.integers(1, 6), st.integers(10_000, 20_000))
@settings(max_examples=150, deadline=None)
def test_every_capacity_holds(lengths, score, documents, attention):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    capacity = (100, documents, attention)
    sequence, offset, count = K.best_fit(lengths, capacity, score=score)
    valid(lengths, sequence, offset, capacity)
    assert count == len(set(sequence.tolist()))


def brute_best_fit(lengths, capacity):
    bins, out = [], []
    for n in lengths:
        need = np.array([n, 1, n * n], float)
        best = None
        for k, left in enumerate(bins):
            if (left >= need).all():
                norm = sum(K.WEIGHTS[d] * ((left[d] - need[d]) / capacity[d]) ** 2 for d in range(3))
                if best is None or norm < best[0] - 1e-15:
                    best = norm, k
        if best is None:
            bins.append(np.array(capacity, float))
            best = 0, len(bins) - 1
        bins[best[1]] -= need
        out.append(best[1])
    return out, len(bins)


def test_best_fit_against_brute_force():
    lengths = -np.sort(-np.random.default_rng(3).integers(1, 4096, 400))
    for capacity in ((4096, 4096, 4096**2), (4096, 5, 4096**2 // 2 + 4096**2 // 2)):
        assert K.best_fit(lengths, capacity)[2] == brute_best_fit(lengths, capacity)[1]


def test_a_piece_beyond_a_capacity_raises():
    with pytest.raises(ValueError):
        K.best_fit(np.array([11]), (10, 5, 1000))


def check_pieces(rows, docs):
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == docs.keys()
    for d, own in pieces.items():
        want = encode(docs[d] or "") + [K.END_ID]
        own.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [
            (k, a, len(part := want[a : a + 4096]), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) for k, a in enumerate(range(0, len(want), 4096))
        ]
    valid(np.array([r["length"] for r in rows]), np.array([r["sequence_id"] for r in rows]), np.array([r["offset"] for r in rows]), (4096, 4096, 4096**2))


def test_documents_of_every_kind(spark):
    docs = {0: None, 1: "", 2: "one two", 3: "word " * 9000, 4: "word " * 4095, 5: "word " * 4096, 6: "x"}
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in docs.items()], "doc_id long, text string, length int, piece string")
    check_pieces(K.pack_documents(df).collect(), docs)
    assert K.pack_documents(df.limit(0)).count() == 0
    twice = K.pack_documents(df.where("doc_id = 6").union(df.where("doc_id = 6"))).collect()
    assert sorted(r["offset"] for r in twice) == [0, 2] and len({r["sequence_id"] for r in twice}) == 1


def test_a_null_doc_id_stays(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one two")], "doc_id long, text string")
    rows = K.pack_documents(df).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["3", "None", "None"] and len({(r["length"], r["ids_crc32"]) for r in rows}) == 1
    assert max(rows, key=lambda r: r["doc_id"] is not None)["offset"] == 0


def test_several_groups_stay_apart(spark):
    df = spark.createDataFrame([(i, 0, 0, 10 + i % 50, 1) for i in range(500)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = K.pack_pieces(df, group_pieces=100).collect()
    valid(np.array([r["length"] for r in rows]), np.array([r["sequence_id"] for r in rows]), np.array([r["offset"] for r in rows]), (4096, 4096, 4096**2))
    assert len(rows) == 500


def test_query_is_nearly_full(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = K.op9_best_fit_packing(spark, sf_dir).collect()
    check_pieces(rows, docs)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 4096) + 1
