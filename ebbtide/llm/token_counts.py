"""Token counts through a digest cache.

Contents are known by the SHA-256 of their text and the tokenizer by a digest of
its file. Stored counts are joined on both digests; only distinct contents without
one are encoded, and their counts appended to the cache, a Parquet table in the
shared folder. Copies are dropped within each task before the shuffle and texts
travel compressed, so a content that a third of all rows share leaves each task
once.

Defined cases: null counts as empty and has no tokens; texts are read whole;
repeated rows each get their row but are encoded once; a null doc_id stays null; an empty table gives an
empty result (and an empty cache); other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, as_bytes, bounded_batches, holds_memory, table, take_worker, tokenizer_file

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4_096
ENCODE_CHARS = 1 << 20
CACHE_SCHEMA = "digest binary, tokenizer binary, n_tokens long"


def tokenizer_digest(path: str) -> bytes:
    """Of the file, and of how it is called."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\nplain ids, no begin, end or added tokens").digest()


@cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


holds_memory(__name__, _processor.cache_clear)


def count_texts(path: str, texts: list[str]) -> list[int]:
    """Tokens of each whole text, some texts a call."""
    counts: list[int] = []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= ENCODE_CHARS):
            chars += len(texts[end])
            end += 1
        counts += map(len, _processor(path).encode(texts[at:end], num_threads=1))
        at = end
    return counts


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, packed text) of contents not yet seen by this task."""
    seen: set[bytes] = set()
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        digests, texts = [], []
        for text in as_bytes(batch.column(0)):
            digest = hashlib.sha256(text).digest()
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                texts.append(pack(text))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["digest", "packed"])


def stored_counts(spark: SparkSession, cache_path: str) -> DataFrame | None:
    """The cache as a table, or None if nothing was stored yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def append_misses(docs: DataFrame, cache_path: str, path: str) -> None:
    """Count the distinct contents of ``docs`` that the cache lacks, and append them to it."""
    spark, version = docs.sparkSession, tokenizer_digest(path)
    bounded_batches(spark)
    firsts = docs.select(F.col("text").cast("string")).mapInArrow(_first_of_each, "digest binary, packed binary")
    stored = stored_counts(spark, cache_path)
    if stored is not None:
        have = stored.where(F.col("tokenizer") == F.lit(version)).select("digest")
        firsts = firsts.join(have, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(__name__)
        seen: set[bytes] = set()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            digests, texts = [], []
            for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    texts.append(unpack(packed).decode("utf-8", "replace"))
            counts = count_texts(path, texts)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([version] * len(digests), pa.binary()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    firsts.repartition("digest").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)


def count_tokens(docs: DataFrame, cache_path: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: its bytes and tokens, and whether those exceed ``limit``."""
    where = path or tokenizer_file(VOCABULARY)
    append_misses(docs, cache_path, where)
    stored = stored_counts(docs.sparkSession, cache_path).where(F.col("tokenizer") == F.lit(tokenizer_digest(where)))
    # two writers may have stored a content twice; written first, the table can be joined to a content of very many rows piece by piece
    counts = Scratch(docs.sparkSession).save(stored.groupBy(F.col("digest").alias("known")).agg(F.max("n_tokens").alias("n_tokens")), "counts")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return asked.join(counts, asked["digest"] == counts["known"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a cache of its own, so that every run counts every content."""
    return count_tokens(table(spark, sf_dir, "documents"), f"{Scratch(spark).path}/token-counts")
