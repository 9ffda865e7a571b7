"""Secret scan: fixed patterns, then novelty against a zstandard dictionary.

The base patterns find assignments, access keys and hex strings. The method then
takes every string of ``CANDIDATE_CHARS`` or more characters between token borders
that holds a sensitive word or begins within ``REACH`` behind one, and that no base
span meets: it is compressed together with the text around it by a compressor primed
with an identifier dictionary, and its marginal bytes (text with it, less text
without it) are its novelty, told per character and as a share of the marginal bytes
of its reverse. Copies of the string, or of ``COPY`` or
more characters of it, are blanked in the surroundings, so that a secret that stands
twice does not explain itself. Strings that the surroundings and the dictionary do
not explain are reported as kind ``novel``, whatever characters they hold: the
compressor decides on every candidate. Long words and names that are explained by
neither are among them, and so are random identifiers such as UUIDs.

The dictionary holds the identifiers of programming languages and those of the corpus
itself, counted exactly over all its texts, each whole: parts of names that stand in
``MIN_DOCUMENTS`` different texts or more, the commonest first, up to
``DICTIONARY_BYTES``. Copies of a text count once. What stands in sensitive context is
never learned.

A text is read from left to right once, whatever it holds, and each candidate is
measured once, against at most ``AROUND`` characters on either side.

Defined cases: null counts as empty and has no spans; texts are read whole;
repeated rows each give their row; a null doc_id stays null; an empty table gives an
empty result; other columns are not read. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map, as_texts, bounded_batches, table, take_worker

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12

#: Whole words or parts of names: neither "keyboard" nor "monkey", but "apiKey" and "auth_token".
SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
    r"(?i:(?:api|access|auth|client|private|secret|session|sign(?:ing)?|encryption)?(?:keys?|tokens?|secrets?|passwords?|passwd|pwd|passphrases?|credentials?)"
    r"|auth(?:orization|entication)?|bearer|private|signatures?)"
    r"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))",
    re.ASCII,
)
#: Each sensitive word holds one of these, in lower case.
CORES = ("key", "token", "secret", "passw", "pwd", "passphrase", "credential", "auth", "bearer", "private", "signature")
_TOKEN_CHARS = "A-Za-z0-9+/_.~-"
CANDIDATE_CHARS = 12
#: From a token's border on; padding may end it.
CANDIDATE = re.compile(rf"(?<![{_TOKEN_CHARS}])[{_TOKEN_CHARS}]{{{CANDIDATE_CHARS},}}={{0,2}}")
REACH = 48  # a candidate begins this near behind a sensitive word
AROUND = 256  # code points of surroundings on either side
COPY = 12  # code points that a copy of a candidate shares with it at least
MIN_NOVELTY = 0.45  # marginal bytes per character
MIN_DISORDER = 0.94  # marginal bytes as a share of those of the same characters in reverse order
WORDS = (
    "abstract access account api app application authorization base bearer build builder cache class client code common config connection constraint content context count create credential "
    "data database date default delete description document element error event example factory field file filter final format function group handler header height host html http https id "
    "identifier image index info init input instance interface interval item java job json key keyboard label language layout length level library limit line list local log login main manager map "
    "max message method min minutes mode model module name node number object offset option order output page param parent parser password path position prefix primary private process production "
    "profile property provider public query queue read reference refresh request resource response result retry return role root row schema script search seconds secret select self server service "
    "session set settings share signature size sort source src start state static status step store stream string system table tag target task template test text thread time timeout title token "
    "transaction tree type unique unit update url user usr value variable vector version view width window worker write www xml"
).split()
DICTIONARY_BYTES = 24 << 10
MIN_DOCUMENTS = 3
COPIED_BROADCAST = 500_000  # digests of 16 bytes with a count each
HELD_NAMES = 100_000  # that a task holds before it gives their counts
LONG_STRETCH = 1 << 20  # code points, beyond which matches are not listed at once
NAME = re.compile(r"[A-Z]?[a-z]{3,23}|[A-Z]{4,24}")
MASK = "[SECRET]"


def base_dictionary() -> bytes:
    names = sorted({*keyword.kwlist, *dir(builtins), *dir(str), *dir(dict), *WORDS, *map(str.upper, WORDS), *map(str.capitalize, WORDS)})
    return "\n".join([*names, *(f"{w} = {w}_{v}" for w, v in zip(WORDS, WORDS[1:], strict=False))]).encode()


def names_of(text: str) -> set[str]:
    """Parts of names outside the strings in sensitive context."""
    found: set[str] = set()
    at = 0
    for start, end in (*candidates(text), (len(text), len(text))):
        found.update(NAME.findall(text, at, start) if start - at <= LONG_STRETCH else (m[0] for m in NAME.finditer(text, at, start)))
        at = end
    return found


def _name_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, copies, n) of rows (text, copies): how many texts of so many copies hold a name."""
    take_worker(__name__)
    held: defaultdict[int, Counter[str]] = defaultdict(Counter)

    def given() -> Iterator[pa.RecordBatch]:
        for copies, seen in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([copies] * len(seen), pa.int64()), pa.array(seen.values(), pa.int64())], names=["name", "copies", "n"])
        held.clear()

    for batch in batches:
        for text, copies in zip(as_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            held[copies].update(names_of(text))
        if sum(map(len, held.values())) > HELD_NAMES:
            yield from given()
    yield from given()


def document_frequencies(docs: DataFrame, text: str = "text", broadcast: int = COPIED_BROADCAST) -> DataFrame:
    """(name, n): in how many different texts of the whole corpus a name stands.

    Texts stay where they are: of c copies each counts, and the sum is divided by c. Only where more than ``broadcast``
    texts have copies do the texts go through a shuffle that leaves one of each.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    digest = F.unhex(F.md5("text"))
    scratch = Scratch(docs.sparkSession)
    copied = scratch.save(texts.groupBy(digest.alias("digest")).agg(F.count("*").alias("copies")).where("copies > 1"), "copied")
    if copied.count() <= broadcast:
        told = texts.join(F.broadcast(copied), digest == F.col("digest"), "left").select("text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    else:
        told = texts.distinct().withColumn("copies", F.lit(1).cast("long"))
    summed = told.mapInArrow(_name_counts, "name string, copies long, n long").groupBy("name", "copies").agg(F.sum("n").alias("n"))
    return summed.groupBy("name").agg(F.sum(F.expr("n div copies")).alias("n"))


def learn_dictionary(docs: DataFrame, text: str = "text") -> bytes:
    """The base dictionary behind the corpus's commonest names (a match is cheapest near the end)."""
    most = DICTIONARY_BYTES // 4  # names have three characters at least, and a line end
    common = document_frequencies(docs, text).where(F.col("n") >= MIN_DOCUMENTS).orderBy(F.desc("n"), "name").limit(most).collect()
    names, size = [], 0
    for name, _ in common:
        if size + len(name) >= DICTIONARY_BYTES:
            break
        names.append(name)
        size += len(name) + 1
    return "\n".join([*names[::-1], ""]).encode() + base_dictionary()


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primer.precompute_compress(level=9)
    return zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)


def _without_copies(around: str, own: str) -> str:
    """``around`` with spaces for whatever stands in a run of ``COPY`` characters of ``own``."""
    runs = {around[i : i + COPY] for i in range(len(around) - COPY + 1)}
    shared = {w for i in range(len(own) - COPY + 1) if (w := own[i : i + COPY]) in runs}
    if not shared:
        return around
    out = list(around)
    for i in range(len(around) - COPY + 1):
        if around[i : i + COPY] in shared:
            out[i : i + COPY] = " " * COPY
    return "".join(out)


@lru_cache(maxsize=4096)  # repeated lines
def _marginal_bytes(before: str, own: str, after: str, dictionary: bytes) -> tuple[int, int]:
    """Of ``own`` and of its characters in reverse order."""
    press = _compressor(dictionary).compress
    around = _without_copies(before, own)[-AROUND:] + _without_copies(after, own)[:AROUND]
    size = lambda s: len(press(s.encode("utf-8", "surrogatepass")))
    known = size(around)
    return size(around + own) - known, size(around + own[::-1]) - known


def novelty(text: str, start: int, end: int, dictionary: bytes) -> tuple[float, float]:
    """Marginal compressed bytes of text[start:end] within its surroundings, other copies of it blanked: per
    character, and as a share of those of its reverse.

    The compressor's price of a character it cannot explain changes with the surroundings; the reverse holds the same
    characters and pays the same price, but nothing that the dictionary or the surroundings explain.
    """
    more = AROUND + COPY - 1  # so that copies across the border are seen
    own = text[start:end]
    measure = _marginal_bytes if len(own) <= AROUND else _marginal_bytes.__wrapped__
    forth, back = measure(text[max(0, start - more) : start], own, text[end : end + more], dictionary)
    return forth / max(1, end - start), (forth + 1) / max(1, back)  # sizes are whole bytes


def is_novel(text: str, start: int, end: int, dictionary: bytes) -> bool:
    per_character, disorder = novelty(text, start, end, dictionary)
    return per_character >= MIN_NOVELTY and disorder >= MIN_DISORDER


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the strings that hold a sensitive word or begin near behind one, from left to right."""
    low = text.lower()
    words = SENSITIVE.finditer(text) if any(c in low for c in CORES) else iter(())
    word, last = next(words, None), None
    if word is None:
        return
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while word is not None and word.start() < end:  # the last word that begins before the string ends
            last, word = word, next(words, None)
        if last is not None and start <= last.end() + REACH:
            yield start, end
        elif word is None:
            return


def novel_spans(text: str, base: list[tuple[int, str, int]], dictionary: bytes) -> list[tuple[int, str, int]]:
    """Incompressible strings in sensitive context, outside the base spans (by start)."""
    found, at, covered = [], 0, 0
    for start, end in candidates(text):
        while at < len(base) and base[at][0] < end:
            covered = max(covered, base[at][2])
            at += 1
        if covered <= start and is_novel(text, start, end, dictionary):
            found.append((start, "novel", end))
    return found


def scan(text: str, dictionary: bytes | None = None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans, each as (start, kind, end) by start and kind."""
    base = base_spans(text)
    return base, sorted([*base, *novel_spans(text, base, dictionary or base_dictionary())], key=lambda x: (x[0], KINDS.index(x[1])))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, and all spans."""
    dictionary = learn_dictionary(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in as_texts(batch.column(1)):
            base, every = scan(text, dictionary)
            kinds = [k for _, k, _ in every]
            out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def redact(text: str, dictionary: bytes | None = None) -> str:
    """The text with every span, overlapping ones merged, replaced by a mask."""
    parts, at = [], 0
    for start, _, end in scan(text, dictionary)[1]:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with secrets masked and ``n_chars`` brought up to date; null texts stay null."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    dictionary = learn_dictionary(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        old = columns[at].to_pylist()
        new = [None if t is None else redact(t, dictionary) for t in old]
        columns[at] = pa.array(new, columns[at].type)
        if chars is not None:
            counts = columns[chars].to_pylist()
            columns[chars] = pa.array([c if n == o else len(n) for o, n, c in zip(old, new, counts, strict=True)], columns[chars].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_map(docs, run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
