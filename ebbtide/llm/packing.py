"""Packing tokenised documents into sequences by vector best-fit.

Every sequence has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths). Pieces go longest first to the open sequence that can
take them under every capacity and leaves the smallest weighted residual norm (or
has the largest weighted dot product with the piece). Documents are cut only where
they are longer than a sequence.

Tokenising writes one small row per piece to the shared folder; these are dealt
evenly, by no key, to groups of at most ``GROUP_PIECES``, and each group is packed
on its own, which costs at most the last sequences of each group. With the default
capacities for documents and attention, which tokens alone keep, sequences are as
full as best-fit decreasing makes them.

Defined cases: null and empty texts have one token (the closing id); texts are read
whole and cut into any number of pieces; repeated rows are packed each; documents of
equal length are taken by doc_id and piece; an empty table gives an empty result;
a null doc_id stays null and comes last among equals; other columns are not read.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map, as_bytes, holds_memory, table, tokenizer_file, without_gc

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SEQUENCE_TOKENS = 4_096
SEQUENCE_DOCUMENTS = 4_096
SEQUENCE_ATTENTION = SEQUENCE_TOKENS**2
WEIGHTS = (1.0, 0.001, 0.001)
GROUP_PIECES = 32_768
MEMO_CHUNKS = 600_000
RUN_CHUNKS = 16_000  # looked up together, of one long text or of some texts
MISSES = 512


class ChunkEncoder:
    """Ids of whole texts, by way of their chunks between ASCII white space.

    The tokenizer drops white space and splits at it before all else, and no
    normalisation crosses it, so a text's ids are its chunks' ids in a row. A
    chunk's ids are kept, packed, while it is in use. New chunks that are words
    are encoded many to a call and told apart by their end-of-word tokens; a comma
    or full stop behind a word is a token of its own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = {i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")}
        self.marks = {m: self._single([m])[0] for m in (".", ",")}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _single(self, chunks: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids := e.ids)}I", *ids) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only; one by one if normalising takes any of them apart."""
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        cuts = [i for i, t in enumerate(ids, 1) if t in self.ends]
        if len(cuts) != len(words):
            return []
        packed = struct.pack(f"<{len(ids)}I", *ids)
        return [packed[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _is_one(self, ids: bytes) -> bool:
        return sum(i in self.ends for i in struct.unpack(f"<{len(ids) // 4}I", ids)) == 1

    def _learn(self, chunks: set[bytes]) -> None:
        """Put the ids of chunks that are not in ``new`` there."""
        new, old, marks = self.new, self.old, self.marks
        if old and (kept := chunks & old.keys()):
            new.update(zip(kept, map(old.__getitem__, kept), strict=True))
            chunks = chunks - kept
        words: set[str] = set()
        marked: list[tuple[bytes, bytes, str]] = []
        others: list[bytes] = []
        for c in chunks:
            s = c.decode("utf-8", "replace")
            if s.isalpha():
                words.add(s)
            elif s[-1] in marks and (word := s[:-1]).isalpha():
                plain = c[:-1]
                marked.append((c, plain, s[-1]))
                if plain not in new:
                    if (found := old.get(plain)) is not None:
                        new[plain] = found
                    else:
                        words.add(word)
            else:
                others.append(c)
        asked = list(words)
        for i in range(0, len(asked), MISSES):
            part = asked[i : i + MISSES]
            new.update(zip((w.encode() for w in part), self._words(part), strict=False))
        for c, plain, mark in marked:
            if (ids := new.get(plain)) is not None and self._is_one(ids):
                new[c] = ids + marks[mark]
        if asked or marked:
            told = set(others)
            others += [c for c in chunks if c not in new and c not in told]
        for i in range(0, len(others), MISSES):
            part = others[i : i + MISSES]
            new.update(zip(part, self._single([c.decode("utf-8", "replace") for c in part]), strict=True))

    def _chunks(self, text: bytes) -> list[bytes]:
        if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()  # nothing here composes with ASCII letters, and no special token comes about
        return text.split()

    def _join(self, runs: list[list[bytes]]) -> list[bytes]:
        """Ids of some runs of chunks, whose new chunks are learned together."""
        every = set().union(*runs)
        missing = every.difference(self.new)
        if missing:
            if len(self.new) > MEMO_CHUNKS // 2:
                self.old, self.new = self.new, {}
                missing = every
            self._learn(missing)
        return [b"".join(map(self.new.__getitem__, run)) for run in runs]

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Packed little-endian 32-bit ids of each UTF-8 text."""
        runs: list[list[bytes]] = []
        held = 0
        for text in texts:
            chunks = self._chunks(text)
            if runs and held + len(chunks) > RUN_CHUNKS:
                yield from self._join(runs)
                runs, held = [], 0
            if len(chunks) > RUN_CHUNKS:
                yield b"".join(self._join([chunks[i : i + RUN_CHUNKS]])[0] for i in range(0, len(chunks), RUN_CHUNKS))
            else:
                runs.append(chunks)
                held += len(chunks)
        yield from self._join(runs)

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all([text]))


@cache
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


holds_memory(__name__, encoder.cache_clear)


def cut_documents(docs: DataFrame, path: str | None = None, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document's ids with the closing id behind them."""
    where, end = path or tokenizer_file(VOCABULARY), struct.pack("<I", END_ID)

    @without_gc
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, pieces, starts, lengths, sums = [], [], [], [], []
        for doc_id, packed in zip(batch.column(0).to_pylist(), encoder(where).encode_all(as_bytes(batch.column(1))), strict=True):
            packed += end
            for piece, at in enumerate(range(0, len(packed), 4 * tokens)):
                part = packed[at : at + 4 * tokens]
                ids.append(doc_id)
                pieces.append(piece)
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                sums.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each piece, in the order given, and the number of sequences.

    ``score``: "norm" takes the sequence whose weighted residual norm is smallest once
    the piece is in, "dot" that whose residual has the largest weighted dot product
    with the piece. Only sequences that can take the piece under every capacity count.
    A piece that exceeds a capacity on its own raises ValueError.
    """
    cap, weight = np.array(capacity, float), np.array(weights, float)
    demand = np.column_stack([lengths, np.ones(len(lengths)), np.square(lengths.astype(float))])
    if len(demand) and (demand > cap).any():
        raise ValueError("a piece is larger than a sequence may be")
    scaled_weight = weight / cap**2
    residual = np.empty((max(16, len(lengths)), 3))
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = demand.min(axis=0) if len(demand) else cap
    open_ids = np.empty(0, np.int64)
    count = 0
    left = np.empty((3, 0))  # residuals of the open sequences, by dimension
    for number, need in enumerate(demand):
        fits = np.flatnonzero((left[0] >= need[0]) & (left[1] >= need[1]) & (left[2] >= need[2])) if left.shape[1] else ()
        if len(fits):
            room = left[:, fits]
            if score == "norm":
                at = fits[np.argmin(sum(scaled_weight[d] * np.square(room[d] - need[d]) for d in range(3)))]
            else:
                at = fits[np.argmax(sum(scaled_weight[d] * need[d] * room[d] for d in range(3)))]
            which = open_ids[at]
        else:
            which, count = count, count + 1
            residual[which] = cap
            at = -1
        sequence[number] = which
        offset[number] = int(cap[0] - residual[which][0])
        residual[which] -= need
        full = (residual[which] < least).any()
        if at >= 0:
            left[:, at] = -1 if full else residual[which]
        elif not full:
            open_ids = np.append(open_ids, which)
            left = np.column_stack([left, residual[which]])
        if number % 1024 == 1023 and left.shape[1]:
            keep = left[0] >= 0
            open_ids, left = open_ids[keep], left[:, keep]
    return sequence, offset, count


def pack_pieces(pieces: DataFrame, capacity: tuple[int, int, int] = (SEQUENCE_TOKENS, SEQUENCE_DOCUMENTS, SEQUENCE_ATTENTION), score: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The piece rows with ``sequence_id`` and ``offset``; read ``pieces`` from a table, since it is counted first."""
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        got = pa.Table.from_batches(rows).combine_chunks()
        got = got.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset, _ = best_fit(got.column("length").to_numpy(), capacity, score=score)
        got = got.append_column("sequence_id", pa.array(sequence + (TaskContext.get().partitionId() << 40)))
        yield from got.append_column("offset", pa.array(offset)).combine_chunks().to_batches()

    return pieces.repartition(groups).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    return pack_pieces(scratch.save(cut_documents(docs, path), "pieces"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
