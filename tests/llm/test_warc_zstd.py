import struct

import pytest
import zstandard

from strandloom.llm import warc_zstd as A

from .common import LONG, table

PAGES = "page_id long, url string, html string"


def rows():
    return [(k, f"http://h/{k}", f"<html><head><title>page {k}</title></head><body>{'text of the page ' * (k % 7)}</body></html>") for k in range(60)]


@pytest.fixture(scope="module")
def dictionary(spark):
    d = A.train_dictionary(table(spark, rows(), PAGES), size=4096)
    assert d
    return d


def read(spark, archives):
    return sorted(((r.page_id, r.target_uri, r.payload, r.valid) for r in A.read_archives(archives).collect()), key=repr)


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(spark, dictionary, packed):
    pages = table(spark, rows() + rows()[:3] + [(None, "u", "x"), (70, None, ""), (71, "http://n", None), (72, "http://l", LONG)], PAGES).selectExpr("*", "1 AS i", "'u' AS u", "2 AS h")
    archives = A.write_archives(pages, dictionary, archive_bytes=3000, compress_dictionary=packed)
    got = read(spark, archives)
    assert got == sorted(((r.page_id, r.url, r.html, True) for r in pages.collect()), key=repr)
    assert A.read_archives(archives).select("archive").distinct().count() > 1


def test_files_of_a_folder(spark, dictionary, tmp_path):
    A.save(A.write_archives(table(spark, rows(), PAGES), dictionary), str(tmp_path / "a"))
    (tmp_path / "a" / "other.txt").write_text("x")
    assert A.load(spark, str(tmp_path / "a")).where("valid").count() == 60


def test_without_dictionary_and_empty(spark):
    assert len(read(spark, A.write_archives(table(spark, rows(), PAGES)))) == 60
    empty = table(spark, [], PAGES)
    assert A.read_archives(A.write_archives(empty)).count() == 0 and A.train_dictionary(empty) == b""
    blanks = spark.createDataFrame([("a", None), ("b", b"")], "path string, content binary")
    assert A.read_archives(blanks).count() == 0


def archive(records, dictionary=b""):
    lead = struct.pack("<II", A.DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(write_checksum=True)
    return lead + b"".join(z.compress(r) for r in records)


GOOD = A.format_record(1, "http://x", "body")


@pytest.mark.parametrize(
    ("record", "error"),
    [
        (GOOD.replace(b"WARC/1.1", b"WARC/9"), "version"),
        (GOOD.replace(b"WARC-Type: response", b"WARC-Type response"), "malformed header"),
        (GOOD.replace(b"WARC-Type: response\r\n", b""), "missing field warc-type"),
        (GOOD.replace(b"Content-Length: 8", b"Content-Length: 9"), "content-length"),
        (GOOD[:-4] + b"abcd", "blank lines"),
        (GOOD.replace(b"body", b"bodx"), "digest"),
        (GOOD[:60], "unended"),
        (b"", "version"),
    ],
)
def test_invalid_records_are_named(record, error):
    got = list(A.records("a", archive([GOOD, record, GOOD])))
    assert [r["valid"] for r in got] == [True, False, True] and error in got[1]["error"]
    assert [r["record"] for r in got] == [0, 1, 2]


def test_http_length_is_validated():
    import base64
    import hashlib

    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nbody"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Date: d\r\nContent-Type: application/http\r\nContent-Length: %d\r\n" % len(block)
    assert "HTTP content-length 3" in A.parse_record(head + b"\r\n" + block + b"\r\n\r\n")["error"]
    digest = base64.b32encode(hashlib.sha1(block).digest())
    fine = block.replace(b"h: 3", b"h: 4")
    assert A.parse_record(head + b"\r\n" + fine + b"\r\n\r\n")["body"] == b"body" and digest


def test_damaged_archives(dictionary):
    whole = archive([GOOD] * 3, dictionary)
    assert all(r["valid"] for r in A.records("a", whole))
    cut = list(A.records("a", whole[:-5]))
    assert [r["valid"] for r in cut] == [True, True, False] and "cut-off" in cut[-1]["error"]
    assert [r["error"] for r in A.records("a", b"plain text, no frame")] == ["no frame at byte 0"]
    assert "dictionary" in next(A.records("a", struct.pack("<II", A.DICT_MAGIC, 4) + b"abcd"))["error"]
    flipped = bytearray(archive([GOOD] * 3))
    flipped[30] ^= 0xFF
    got = list(A.records("a", bytes(flipped)))
    assert not got[0]["valid"]


def test_frames_are_found_by_their_headers():
    for payload in (b"", b"a", b"a" * 100_000, bytes(range(256)) * 3000):
        for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
            frame = zstandard.ZstdCompressor(**options).compress(payload)
            assert A.frame_end(memoryview(frame + b"tail"), 0) == len(frame)


def message(block, **fields):
    lines = {"WARC-Type": "response", "WARC-Record-ID": "<x>", "WARC-Date": "d", "Content-Type": "application/http", "Content-Length": str(len(block))} | fields
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\n\r\nbody"
HOSTILE = [
    (message(HTTP, **{"Content-Length": "9" * 20}), "content-length out of range"),
    (message(HTTP, **{"Content-Length": "9" * 5000}), "content-length out of range"),
    (message(HTTP, **{"Content-Length": "-1"}), "malformed content-length"),
    (message(HTTP, **{"X-Page-Id": "9" * 20}), "x-page-id out of range"),
    (message(HTTP, **{"X-Page-Id": "-" + "9" * 20}), "x-page-id out of range"),
    (message(HTTP, **{"X-Page-Id": "\u00b2"}), "malformed x-page-id"),
    (message(HTTP, **{"X-Page-Id": "--5"}), "malformed x-page-id"),
    (message(HTTP, **{"X-Page-Id": ""}), "malformed x-page-id"),
    (message(HTTP.replace(b"200", b"999999999999")), "malformed HTTP"),
    (message(HTTP.replace(b"200", b"20\xb2")), "malformed HTTP"),
    (message(HTTP.replace(b"OK\r\n", b"OK\r\nContent-Length: " + b"7" * 6000 + b"\r\n")), "HTTP content-length out of range"),
    (message(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\nbody"), "malformed chunk"),
    (message(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nff\r\nbody"), "cut-off chunk"),
    (message(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n"), "malformed chunk"),
]


def test_hostile_headers_never_stop_the_job(spark):
    files = spark.createDataFrame([("a", archive([GOOD] + [r for r, _ in HOSTILE] + [GOOD]))], "path string, content binary")
    got = {r.record: r for r in A.read_archives(files).collect()}
    assert len(got) == len(HOSTILE) + 2 and got[0].valid and got[len(HOSTILE) + 1].valid
    for k, (_, error) in enumerate(HOSTILE, 1):
        assert not got[k].valid and error in got[k].error, (k, got[k])


def test_bytes_and_chunks(spark):
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\n4;x=1\r\nbody\r\nA\r\n0123456789\r\n0\r\n\r\n"
    image = message(b"HTTP/1.1 200 OK\r\n\r\n\xff\xd8\x00", **{"X-Page-Id": str(-(1 << 63))})
    other = message(b"\xc3\xa9", **{"WARC-Type": "resource", "X-Page-Id": "007"})
    files = spark.createDataFrame([("a", archive([message(chunked), image, other]))], "path string, content binary")
    got = sorted(A.read_archives(files).collect(), key=lambda r: r.record)
    assert all(r.valid for r in got) and [bytes(r.body) for r in got] == [b"body0123456789", b"\xff\xd8\x00", b"\xc3\xa9"]
    assert [r.payload for r in got] == ["body0123456789", None, "\u00e9"] and [r.page_id for r in got] == [None, -(1 << 63), 7]
