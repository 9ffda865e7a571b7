"""WARC archives in Zstandard: written with a dictionary, one frame per record, and read back.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds its
dictionary; every record is a frame of its own, compressed with it. A reader loads
the dictionary, decodes frame by frame and checks each record's version, headers,
lengths and digest. Archives go through Spark's own text sink, one per file, with an
empty skippable frame (which decoders pass over) as its line end, and come back
through the binary file source, so they live wherever Spark can write.

Of records with equal payloads of at least ``min_revisit_bytes``, that with the
smallest page_id is a response and the others are revisits that refer to it.

Defined cases: null html counts as empty, and empty payloads are equal like any
others; payloads of any length stay whole; a repeat of a response's row is a response
too; a null page_id comes last, and a group without any other holds responses only;
control characters in a url are percent-encoded; an empty table gives no archive and
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, bounded_batches, table

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
LINE_END = "P*M\x18\x00\x00\x00\x00"  # a skippable frame without content
ARCHIVE_BYTES = 8 << 20  # of records before compression
DICTIONARY_BYTES = 32 << 10
SAMPLES = 256
SAMPLE_BYTES = 16 << 10
LEVEL = 3
SHARED_BROADCAST = 200_000  # digests of 32 bytes with a page each
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """The bytes are no archive of this kind, or a record does not hold what its headers say."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(null|-?\d+)>", record_id)
    if not m:
        raise ArchiveError(f"no page in record id {record_id!r}")
    return None if m[1] == "null" else int(m[1])


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-none")


def render_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response record, or a revisit of page ``first`` where that is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [f"WARC-Refers-To: {_record_id(first)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[str, dict[str, str], int]:
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ArchiveError("headers do not end")
    first, *lines = data[at:end].decode().split("\r\n")
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in found:
            raise ArchiveError(f"bad header {line!r}")
        found[name.lower()] = value.strip()
    return first, found, end + 4


def _required(found: dict[str, str], *names: str) -> None:
    if missing := [n for n in names if n not in found]:
        raise ArchiveError(f"headers missing: {missing}")


def _length(found: dict[str, str]) -> int:
    if not re.fullmatch(r"[0-9]+", found["content-length"]):
        raise ArchiveError(f"no length: {found['content-length']!r}")
    return int(found["content-length"])


def parse_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, page referred to) of one record, checked."""
    version, head, at = _headers(data, 0)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"version {version!r}")
    _required(head, "warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest")
    length = _length(head)
    block = data[at : at + length]
    if len(block) != length or data[at + length :] != b"\r\n\r\n":
        raise ArchiveError("the record is not as long as its headers say")
    status, http, start = _headers(block, 0)
    if not status.startswith("HTTP/"):
        raise ArchiveError(f"status line {status!r}")
    _required(http, "content-length")
    size, body = _length(http), block[start:]
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(body) != size or payload_digest(body) != digest:
            raise ArchiveError("the payload is not what its headers say")
        return _page_of(head["warc-record-id"]), size, digest, kind, None
    if kind != "revisit" or body:
        raise ArchiveError(f"record type {kind!r} with {len(body)} bytes of payload")
    _required(head, "warc-refers-to")
    return _page_of(head["warc-record-id"]), size, digest, kind, _page_of(head["warc-refers-to"])


def make_dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on a bounded sample, or plain text of it where there is too little to train on."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step][:SAMPLES]]
    if sum(map(len, samples)) >= 16 * DICTIONARY_BYTES and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # too uniform to train on
            pass
    return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def write_archive(records: list[bytes]) -> bytes:
    dictionary = make_dictionary(records)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary, *map(press.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """The end of the Zstandard frame that begins at ``at``, by its block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if end + 3 > len(data):
            raise ArchiveError("a frame is cut short")
        head = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise ArchiveError("a frame is cut short")
    return end


def read_archive(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, each decoded from its own frame."""
    data = memoryview(archive)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise ArchiveError("no dictionary frame leads the archive")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    open_frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8:at])))
    while at < len(data):
        if at + 8 > len(data):
            raise ArchiveError("a frame is cut short")
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ArchiveError(f"no frame at {at}")
        end = frame_end(data, at)
        yield open_frame.decompress(data[at:end])
        at = end


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of the rows (page_id, url, payload, first), each of about ``ARCHIVE_BYTES``."""
    records: list[bytes] = []
    size = 0
    wrap = lambda: pa.RecordBatch.from_arrays([pa.array([write_archive(records)], pa.binary())], names=["archive"])
    for batch in batches:
        for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            records.append(render_record(page_id, url, payload, first))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield wrap()
                records, size = [], 0
    if records:
        yield wrap()


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # payloads too small to be revisited have no key and find no first
    key = F.when(F.octet_length("payload") >= min_revisit_bytes, F.unhex(F.sha2(F.col("payload"), 256)))
    keyed = rows.withColumn("key", key)
    shared = keyed.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("of")).agg(F.min("page_id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    firsts = Scratch(pages.sparkSession).save(shared.select("of", "least"), "firsts")
    # payloads stay where they are while the digests that several pages share are few enough to send everywhere; beyond, they are joined by digest
    hint = "broadcast" if firsts.count() <= SHARED_BROADCAST else "merge"
    told = keyed.join(firsts.hint(hint), keyed["key"] == firsts["of"], "left")
    first = F.when(F.col("least").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("least"))), F.col("least"))
    archives = told.select("page_id", "url", "payload", first.alias("first")).mapInArrow(_written, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", LINE_END).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            if archive.strip(LINE_END.encode()):
                rows = list(map(parse_record, read_archive(archive)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).path}/archives"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP8_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT *, array_to_string([lpad(bin(('0x' || substr(hex, i, 1))::INT), 4, '0') FOR i IN range(1, 41)], '') AS bits FROM d),
r AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([(substr(bits, 5 * j + k, 1))::INT << (5 - k) FOR k IN [1, 2, 3, 4, 5]])::INT, 1) FOR j IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""
