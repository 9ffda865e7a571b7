import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import bpe as B

PATH = public_tokenizers.path(B.VOCABULARY)
RANKS = B.read_ranks(PATH)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = B.codec(PATH)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    packed = CODEC.encode(text)
    assert ids(packed) == ORACLE.encode_ordinary(text)
    data, parts = zip(*CODEC.decode(packed), strict=True)
    assert b"".join(data) == text.encode() and "".join(parts) == text


def test_words_and_odd_texts():
    rng = random.Random(0)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 30))) for _ in range(3000)]
    for text in [*words, "", "<|endoftext|>", "a" * 5000, " " * 300 + "x", "\x1c\x85​　y", "ſ İ ΟΔΟΣ 漢字😀", "'s 'S don't"]:
        assert ids(CODEC.encode(text)) == ORACLE.encode_ordinary(text)


def test_tables_that_overflow_are_made_anew(monkeypatch):
    monkeypatch.setattr(B, "MAX_STATES", 20)
    monkeypatch.setattr(B, "MAX_PIECES", 10)
    small, rng = B.Codec(PATH), random.Random(1)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcdehilnorst", k=rng.randrange(1, 25))) for _ in range(5))
        assert ids(small.encode(text)) == ORACLE.encode_ordinary(text)
    assert len(small.pieces) <= 10


def test_small_vocabulary_against_plain_merging():
    merges = [b"ab", b"bc", b"abc", b"cab", b"aa", b"aab", b"bcab"]
    ranks = {bytes([i]): i for i in range(256)} | {m: 256 + k for k, m in enumerate(merges)}
    tool, rng = B.Transducer(ranks), random.Random(2)
    for _ in range(3000):
        piece = bytes(rng.choices(b"abc", k=rng.randrange(1, 14)))
        if piece not in ranks:
            assert tool.encode(piece) == B.merge_by_rank(ranks, piece)


def test_lookahead_is_bounded():
    tool = B.Transducer(RANKS)
    tool.encode(b"internationalisation" * 200)
    assert max(len(s[1]) for s in tool.states) < 2 * max(map(len, RANKS))


CUT_TOKENS = [t for t in RANKS if t.decode("utf-8", "replace").encode() != t]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_utf8_stream(size):
    data, stream = "aé漢😀z".encode(), B.Utf8Stream()
    assert "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.close() == "aé漢😀z"
    broken = B.Utf8Stream()
    assert broken.feed(b"\xe6\xbc") == "" and broken.close() == "�"


def test_the_automaton_against_the_codec_on_all_kinds_of_bytes():
    rng = random.Random(4)
    starts = [b"\xf0\x9f\x98\x80", b"\xe6\xbc\xa2", b"\xc3\xa9", b"a", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xe0\x80\x80", b"\xff", b"\x80"]
    for _ in range(3000):
        data = b"".join(s[: rng.randrange(1, len(s) + 1)] for s in rng.choices(starts, k=rng.randrange(1, 9)))
        stream, parts, at = B.Utf8Stream(), [], 0
        while at < len(data):
            step = rng.randrange(1, 4)
            parts.append(stream.feed(data[at : at + step]))
            at += step
        assert "".join(parts) + stream.close() == data.decode("utf-8", "replace")


def test_tokens_that_cut_characters_and_tokens_that_are_no_text(monkeypatch):
    monkeypatch.setattr(B, "DECODE_STEP", 3)
    rng, texts = random.Random(5), []
    for _ in range(400):
        picked = [RANKS[t] for t in rng.sample(CUT_TOKENS, 5)] + rng.choices(range(len(RANKS)), k=6)
        rng.shuffle(picked)
        texts.append([i for i in picked if i in CODEC.bytes_of])
    texts += [[RANKS[bytes([b])] for b in "aé漢😀z".encode()], [RANKS[b"\xf0"]], [RANKS[b"\x80"]] * 5, []]
    for picked in texts:
        whole = b"".join(CODEC.bytes_of[i] for i in picked)
        data, parts = zip(*CODEC.decode(B.packed_ids(picked)), strict=True)
        assert b"".join(data) == whole and "".join(parts) == whole.decode("utf-8", "replace")


def test_documents(spark):
    texts = [None, "", "same", "same", "long text " * 20_000]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in B.encode_documents(df).collect():
        text = texts[r["doc_id"]] or ""
        want = ORACLE.encode_ordinary(text)
        assert tuple(r)[1:4] == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert r["decoded_chars"] == len(text)
    assert B.encode_documents(df.limit(0)).count() == 0
    nameless = B.encode_documents(spark.createDataFrame([(None, "a b", 1)], df.schema)).first()
    assert nameless["doc_id"] is None and nameless["n_tokens"] == 2


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in B.op7_byte_bpe(spark, sf_dir).collect():
        want = ORACLE.encode_ordinary(docs[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
