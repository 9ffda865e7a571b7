import struct

import pytest
import zstandard

from ebbtide.llm import warc as W
from ebbtide.llm._common import Scratch


def record(i, body=b"<p>x</p>", first=None):
    return W.render_record(i, "http://a.b/c d\r\nX: y", body, first)


def test_archive_layout_and_round_trip():
    records = [record(i, b"<html>%d</html>" % i * 50) for i in range(100)] + [record(-5, b"", 3)]
    archive = W.write_archive(records)
    magic, size = struct.unpack_from("<II", archive)
    assert magic == 0x184D2A5D and size > 0
    padded = archive + W.LINE_END.encode()
    assert list(W.read_archive(padded)) == records
    assert W.parse_record(records[7])[:2] == (7, len(b"<html>7</html>") * 50)
    assert W.parse_record(records[-1])[3:] == ("revisit", 3)
    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    assert b"".join(whole.stream_reader(archive, read_across_frames=True).readall() for _ in "x") == b"".join(records)


def test_dictionary_is_trained_where_there_is_enough():
    import random

    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    records = [record(i, " ".join(rng.choices(words, k=600)).encode()) for i in range(300)]
    assert W.make_dictionary(records).startswith(b"\x37\xa4\x30\xec")
    assert list(W.read_archive(W.write_archive(records))) == records
    assert list(W.read_archive(W.write_archive([b""]))) == [b""]


def test_damage_is_found():
    good = record(1)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"<p>x", b"<p>y"), good.replace(b"WARC-Date", b"X-Date"), good + b"more", good.replace(b"response\r\nWARC-R", b"metadata\r\nWARC-R")):
        with pytest.raises((W.ArchiveError, ValueError)):
            W.parse_record(bad)
    revisit = W.render_record(2, "u", b"<p>x", 1)
    assert W.parse_record(revisit)[3:] == ("revisit", 1)
    for bad in (revisit.replace(b"WARC-Refers-To", b"X-Refers-To00"), revisit.replace(b"html; charset=utf-8\r\nContent-Length", b"html; charset=utf-8\r\nXontent-Length"), good.replace(b"Content-Length: ", b"Content-Length: x")):
        with pytest.raises(W.ArchiveError):
            W.parse_record(bad)
    archive = W.write_archive([good])
    for bad in (b"none", archive[8:], archive[:-5], archive + b"12345678901"):
        with pytest.raises((W.ArchiveError, zstandard.ZstdError)):
            list(W.read_archive(bad))


PAGES = [(4, "u4", "same"), (2, "u2", "same"), (9, None, "same"), (2, "u2", "same"), (None, "n", "same"), (5, "a\nb", None), (6, "", ""), (7, "x", "é" * 70_000), (None, "n", "alone"), (8, "big", "z" * 20_000_000)]


def expected(least):
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        group = [j for j, _, h in PAGES if (h or "").encode() == data and j is not None]
        first = min(group) if group and len(data) >= least else None
        revisit = first is not None and i != first
        out.append((i, len(data), W.payload_digest(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,most", [(0, W.SHARED_BROADCAST), (0, 0), (1, 0), (10, W.SHARED_BROADCAST)])
def test_written_and_read_back(spark, monkeypatch, least, most):
    monkeypatch.setattr(W, "SHARED_BROADCAST", most)  # either way of finding the first
    df = spark.createDataFrame([(*p, 1, "k") for p in PAGES], "page_id long, url string, html string, first int, payload string")
    path = f"{Scratch(spark).path}/w"
    W.write_archives(df, path, least)
    assert sorted((tuple(r) for r in W.read_archives(spark, path).collect()), key=str) == expected(least)


def test_empty_table(spark):
    path = f"{Scratch(spark).path}/w"
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.read_archives(spark, path).count() == 0
