import public_tokenizers
import sentencepiece

from ebbtide.llm import token_counts as C
from ebbtide.llm._common import Scratch

PATH = public_tokenizers.path(C.VOCABULARY)
ORACLE = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [None, "", "same text", "same text", " same text", "<s> </s> <unk>", "漢字😀 ñ\x00x", "word " * 30_000]


def test_counts_and_cache(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, digest binary")
    path = f"{Scratch(spark).path}/cache"
    want = {i: (len((t or "").encode()), n := len(ORACLE.encode(t or "")), n > C.LIMIT) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: tuple(r)[1:] for r in C.count_tokens(df, path).collect()} == want
    assert C.stored_counts(spark, path).count() == len(set(t or "" for t in TEXTS))
    more = df.union(spark.createDataFrame([(99, "new words", 1, b"x")], df.schema))
    again = {r["doc_id"]: tuple(r)[1:] for r in C.count_tokens(more, path).collect()}
    assert again == want | {99: (9, len(ORACLE.encode("new words")), False)}
    stored = [r["digest"] for r in C.stored_counts(spark, path).collect()]
    assert len(stored) == len(set(map(bytes, stored))) == len(set(t or "" for t in TEXTS)) + 1


def test_another_tokenizer_version_has_its_own_counts(spark):
    df, path = spark.createDataFrame([(1, "abc")], "doc_id long, text string"), f"{Scratch(spark).path}/cache"
    other = spark.createDataFrame([(bytearray(__import__("hashlib").sha256(b"abc").digest()), bytearray(b"old"), 77)], C.CACHE_SCHEMA)
    other.write.parquet(path)
    assert C.count_tokens(df, path).first()["n_tokens"] == len(ORACLE.encode("abc"))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert C.count_tokens(df, f"{Scratch(spark).path}/cache").count() == 0


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: tuple(r)[1:3] for r in C.op10_token_counts(spark, sf_dir).collect()}
    assert rows == {i: (len(t.encode()), len(ORACLE.encode(t))) for i, t in docs.items()}


def test_a_null_doc_id_stays(spark):
    df = spark.createDataFrame([(None, "abc"), (1, "abc")], "doc_id long, text string")
    rows = C.count_tokens(df, f"{Scratch(spark).path}/cache").collect()
    assert {r["doc_id"] for r in rows} == {None, 1} and len({tuple(r)[1:] for r in rows}) == 1
