"""Quality rules as a short-circuit cascade.

Each rule rejects a text by cheap counts. A bounded sample, drawn by hash, gives every
rule's cost and rejection rate among the texts that the rules before it leave, counts
that those have made already being free; the cascade then runs the rules by rejection
per cost, and a rule sees only the texts that all rules before it let pass. Counts are
made when a rule first asks for them. The order changes the work, never the verdict.

Defined cases: null and empty texts have zero words and are rejected (too
short); a text of any length is read whole; repeated rows are judged each on its
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import hash_sample
from ._common import arrow_map, as_bytes, table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_SYMBOLS_PER_WORD = 0.2
MAX_DUP_LINE_SHARE = 0.5
WORD_CHARS_RANGE = (2, 30)
MAX_NON_LETTER_SHARE = 0.5
SAMPLE_ROWS = 256
SAMPLE_BYTES = 64 << 10
BLOCK_BYTES = 1 << 20

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_NON_LETTERS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalpha())


def repeat_words(docs: list[list[bytes]]) -> np.ndarray:
    """Words of each document that lie in a 5-word window found twice or more in it.

    Windows are compared by a 64-bit mix first; those that meet are compared word by word.
    """
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(len(docs), np.int64)
    codes: dict[bytes, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for w in chain.from_iterable(docs)), np.int64, total)
    owner = np.repeat(np.arange(len(docs)), lengths)
    starts = np.flatnonzero(owner[: total - WINDOW + 1] == owner[WINDOW - 1 :]) if total >= WINDOW else np.empty(0, np.int64)
    mix = owner[starts].astype(np.uint64)
    for k in range(WINDOW):
        mix = (mix ^ flat[starts + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    ordered = np.sort(mix)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice) == 0:
        return np.zeros(len(docs), np.int64)
    starts = starts[np.isin(mix, twice)]
    keys = np.stack([owner[starts], *(flat[starts + k] for k in range(WINDOW))])
    order = np.lexsort(keys)
    same = (np.diff(keys[:, order], axis=1) == 0).all(axis=0)
    found = np.zeros(len(starts), bool)
    found[1:] |= same
    found[:-1] |= same
    starts = starts[order[found]]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(docs)).astype(np.int64)


class Block:
    """Some texts and their counts, each computed when first asked for and only for the texts asked for."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.words: list[list[bytes] | None] = [None] * len(texts)
        self.known: dict[str, np.ndarray] = {}

    def copy(self) -> Block:
        other = Block(self.texts)
        other.words, other.known = list(self.words), {k: v.copy() for k, v in self.known.items()}
        return other

    def count(self, name: str, at: np.ndarray) -> np.ndarray:
        have = self.known.setdefault(name, np.full(len(self.texts), -1, np.int64))
        todo = at[have[at] < 0]
        if len(todo):
            have[todo] = COUNTS[name](self, todo)
        return have[at]

    def split(self, at: np.ndarray) -> list[list[bytes]]:
        for i in at:
            if self.words[i] is None:
                self.words[i] = self.texts[i].split()
        return [self.words[i] for i in at]


def _kept_bytes(drop: bytes) -> Callable[[Block, np.ndarray], list[int]]:
    return lambda b, at: [len(b.texts[i].translate(None, drop)) for i in at]


def _counted_bytes(which: bytes) -> Callable[[Block, np.ndarray], list[int]]:
    return lambda b, at: [len(t := b.texts[i]) - len(t.translate(None, which)) for i in at]


def _lines(block: Block, at: np.ndarray) -> list[list[bytes]]:
    return [[x for x in block.texts[i].split(b"\n") if x.strip()] for i in at]


COUNTS: dict[str, Callable] = {
    "n_words": lambda b, at: [len(w) for w in b.split(at)],
    "word_chars": _kept_bytes(_SPACE + _CONTINUATION),
    "n_symbols": _counted_bytes(_SYMBOLS),
    "n_non_letters": _counted_bytes(_NON_LETTERS),
    "n_lines": lambda b, at: [len(x) for x in _lines(b, at)],
    "n_dup_lines": lambda b, at: [len(x) - len(set(x)) for x in _lines(b, at)],
    "n_repeat_words": lambda b, at: repeat_words(b.split(at)),
}

#: name -> rejects(block, which)
RULES: dict[str, Callable[[Block, np.ndarray], np.ndarray]] = {
    "too_short": lambda b, at: b.count("n_words", at) < MIN_WORDS,
    "repeats": lambda b, at: 100 * b.count("n_repeat_words", at) > MAX_REPEAT_PERCENT * b.count("n_words", at),
    "symbols": lambda b, at: b.count("n_symbols", at) > MAX_SYMBOLS_PER_WORD * b.count("n_words", at),
    "duplicate_lines": lambda b, at: b.count("n_dup_lines", at) > MAX_DUP_LINE_SHARE * b.count("n_lines", at),
    "word_length": lambda b, at: (b.count("word_chars", at) < WORD_CHARS_RANGE[0] * b.count("n_words", at)) | (b.count("word_chars", at) > WORD_CHARS_RANGE[1] * b.count("n_words", at)),
    "non_letters": lambda b, at: b.count("n_non_letters", at) > MAX_NON_LETTER_SHARE * b.count("word_chars", at),
}
BASE_RULES = ("too_short", "repeats")
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(block: Block, order: list[str]) -> np.ndarray:
    """True for each text that passes every rule; later rules see only what earlier ones let pass."""
    alive = np.arange(len(block.texts))
    for name in order:
        if len(alive):
            alive = alive[~RULES[name](block, alive)]
    kept = np.zeros(len(block.texts), bool)
    kept[alive] = True
    return kept


def blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in order, some at a time."""
    start = held = 0
    for end, text in enumerate(texts):
        if held and held + len(text) > size:
            yield Block(texts[start:end])
            start, held = end, 0
        held += len(text)
    if start < len(texts):
        yield Block(texts[start:])


def order_rules(texts: list[bytes]) -> list[str]:
    """Rule names by rejections per nanosecond, each measured on what the rules before it leave of ``texts``."""
    block, alive, order = Block(texts), np.arange(len(texts)), []
    while len(order) < len(RULES):
        best = None
        for name in RULES:
            if name in order:
                continue
            trial, began = block.copy(), time.perf_counter_ns()
            bad = RULES[name](trial, alive) if len(alive) else np.zeros(0, bool)
            worth = (int(bad.sum()) + 0.5) / max(time.perf_counter_ns() - began, 1)
            if best is None or worth > best[0]:
                best = worth, name, trial, bad
        _, name, block, bad = best
        order.append(name)
        alive = alive[~bad]
    return order


def rule_order(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The order for a corpus, from ``sample_rows`` of its texts of up to ``SAMPLE_BYTES`` each."""
    short = docs.select(F.col(text).cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    sample = hash_sample(short, ["text"], sample_rows, docs.count()).collect()  # bounded in rows and bytes
    return order_rules([(r["text"] or "").encode("utf-8", "surrogatepass") for r in sample])


def quality_report(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per document: its counts, the base verdict and the cascade's."""
    rules = order or rule_order(docs)

    def verdicts(block: Block) -> list[np.ndarray]:
        kept, every = cascade(block, rules), np.arange(len(block.texts))
        base = [block.count(name, every) for name in BASE_COUNTS]  # what the cascade has left open is counted for the report
        failed = np.zeros(len(every), bool)
        for name in BASE_RULES:
            failed |= RULES[name](block, every)
        return [*base, failed, kept]

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [verdicts(b) for b in blocks(as_bytes(batch.column(1)))] or [verdicts(Block([]))]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, columns)],
            names=["doc_id", *BASE_COUNTS, "base_failed", "kept"],
        )

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in BASE_COUNTS) + ", base_failed boolean, kept boolean"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), judge, schema)


def keep_good(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The documents that pass the cascade, with all their columns."""
    rules, at = order or rule_order(docs), docs.columns.index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [cascade(b, rules) for b in blocks(as_bytes(batch.column(at)))]
        return batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return arrow_map(docs, keep, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, ws[i:i+4] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(text, '[^\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_non_letters
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.2 * n_words OR n_dup_lines > 0.5 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 30 * n_words OR n_non_letters > 0.5 * word_chars) AS kept
FROM b
"""
