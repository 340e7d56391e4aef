"""Zstandard-compressed web archives (.warc.zst): reader, and a writer to test it with.

Layout: an optional leading skippable frame (magic 0x184D2A5D) whose content is
the dictionary, plain or itself compressed, then one zstandard frame per WARC
record.  Frames are found by walking their headers and block headers, so a
damaged frame doesn't hide the ones after it where its block sizes are intact.

The reader validates each record: version line, header syntax, the four
mandatory fields, ``Content-Length`` against the block, the record's closing
blank lines, ``WARC-Block-Digest`` (sha1) and, for HTTP responses, the message
head and its ``Content-Length`` or chunks.  Numbers are ASCII digits within the
range of their column.  A record that fails has ``error`` set and ``valid``
false; it never stops the job.

``body`` holds the bytes of the record's block, of an HTTP message those after
its head, with chunks joined; what a content encoding did to them stays.
``payload`` is the same as text, and null where the bytes aren't UTF-8.

Cases: an archive of no records, an empty or null content gives no rows; an
archive without a dictionary is read without one; a file that isn't one gives a
single row with an error.  Records are numbered in file order, repeated records
keep rows of their own.  Blocks of any length are decoded whole.  In writing, a
null url leaves out the target field and a null html the block (both read back
as null); null ids are left out too.  Columns other than the named aren't read.
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
from pyspark.sql import types as T

from .textkit import tidy

DICT_MAGIC, ZSTD_MAGIC, RAW_DICT_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
FIELDS = (
    ("archive", T.StringType()), ("record", T.LongType()), ("warc_type", T.StringType()), ("record_id", T.StringType()), ("target_uri", T.StringType()),
    ("warc_date", T.StringType()), ("page_id", T.LongType()), ("content_length", T.LongType()), ("http_status", T.IntegerType()), ("body", T.BinaryType()), ("valid", T.BooleanType()), ("error", T.StringType()),
)
SCHEMA = T.StructType([T.StructField(n, t) for n, t in FIELDS])
_ARROW = {T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}


class Damaged(ValueError):
    """Something in an archive that isn't as it must be."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstandard frame that begins at ``at`` ends, from its headers alone."""
    if len(data) - at < 6:
        raise Damaged("cut-off frame header")
    flags = data[at + 4]
    single, check = flags >> 5 & 1, flags >> 2 & 1
    pos = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if pos + 3 > len(data):
            raise Damaged("cut-off block")
        head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * check
    if pos > len(data):
        raise Damaged("cut-off frame")
    return pos


def read_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise Damaged("cut-off dictionary frame")
    content = bytes(data[8 : 8 + size])
    magic = struct.unpack_from("<I", content)[0] if size >= 4 else 0
    if magic == ZSTD_MAGIC:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    elif magic != RAW_DICT_MAGIC:
        raise Damaged("the leading skippable frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content), 8 + size


def _head(raw: bytes) -> dict[str, str]:
    fields: dict[str, str] = {}
    last = ""
    for line in raw.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise Damaged("malformed header line")
        last = name.decode("utf-8", "replace").lower()
        fields.setdefault(last, value.strip().decode("utf-8", "replace"))
    return fields


def _number(raw: str, what: str, low: int = 0, high: int = (1 << 63) - 1) -> int:
    """A number of ASCII digits within a range, of any length in writing."""
    digits = raw[1:] if raw.startswith("-") and low < 0 else raw
    if not digits.isascii() or not digits.isdigit():
        raise Damaged(f"malformed {what}")
    size = digits.lstrip("0") or "0"
    found = int(size) if len(size) <= 20 else 1 << 64
    if not low <= (found := -found if digits != raw else found) <= high:
        raise Damaged(f"{what} out of range")
    return found


def _joined(body: bytes) -> bytes:
    """The bytes of a chunked HTTP body."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise Damaged("malformed chunk")
        if not (n := int(size, 16)):
            return b"".join(out)
        at = end + 2 + n
        if body[at : at + 2] != b"\r\n":
            raise Damaged("cut-off chunk")
        out.append(body[end + 2 : at])
        at += 2


def parse_record(raw: bytes) -> dict:
    """The fields of one decompressed record; ``error`` names the first thing wrong."""
    row: dict = {"valid": False}
    try:
        head, blank, rest = raw.partition(b"\r\n\r\n")
        version, _, lines = head.partition(b"\r\n")
        if version not in (b"WARC/1.0", b"WARC/1.1"):
            raise Damaged("no WARC version line")
        if not blank:
            raise Damaged("unended header")
        h = _head(lines)
        row |= {"warc_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date")}
        if missing := [x for x in MANDATORY if x not in h]:
            raise Damaged(f"missing field {missing[0]}")
        row["content_length"] = length = _number(h["content-length"], "content-length")
        if (own := h.get("x-page-id")) is not None:
            row["page_id"] = _number(own, "x-page-id", -(1 << 63))
        if len(rest) != length + 4:
            raise Damaged(f"content-length {length}, but the block has {len(rest) - 4} bytes")
        block, tail = rest[:length], rest[length:]
        if tail != b"\r\n\r\n":
            raise Damaged("no blank lines after the block")
        digest = h.get("warc-block-digest", "")
        if digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise Damaged("block digest differs")
        if h["warc-type"] == "response" and h.get("content-type", "").startswith("application/http"):
            top, blank, body = block.partition(b"\r\n\r\n")
            status, _, lines = top.partition(b"\r\n")
            parts = status.split(b" ", 2)
            if not blank or not parts[0].startswith(b"HTTP/") or len(parts) < 2 or not re.fullmatch(rb"[1-9][0-9]{2}", parts[1]):
                raise Damaged("malformed HTTP message")
            fields = _head(lines) if lines else {}
            if fields.get("transfer-encoding", "").lower().endswith("chunked"):
                body = _joined(body)
            elif (said := fields.get("content-length")) is not None and _number(said, "HTTP content-length") != len(body):
                raise Damaged(f"HTTP content-length {said[:20]}, but the body has {len(body)} bytes")
            row |= {"http_status": int(parts[1]), "body": body}
        elif length:
            row["body"] = block
        row["valid"] = True
    except Damaged as e:
        row["error"] = str(e)
    return row


def records(archive: str, content: bytes) -> Iterator[dict]:
    """The records of one archive, one for each frame."""
    data, number = memoryview(content), 0
    try:
        dictionary, at = read_dictionary(data)
        zstd = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while at < len(data):
            magic = struct.unpack_from("<I", data, at)[0] if at + 8 <= len(data) else 0
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                at += 8 + struct.unpack_from("<I", data, at + 4)[0]
                if at > len(data):
                    raise Damaged("cut-off skippable frame")
                continue
            if magic != ZSTD_MAGIC:
                raise Damaged(f"no frame at byte {at}")
            end = frame_end(data, at)
            try:
                row = parse_record(zstd.decompressobj().decompress(data[at:end]))
            except zstandard.ZstdError as e:
                row = {"valid": False, "error": f"frame can't be decompressed: {str(e)[:80]}"}
            yield {"archive": archive, "record": number} | row
            number, at = number + 1, end
    except (Damaged, zstandard.ZstdError) as e:
        yield {"archive": archive, "record": number, "valid": False, "error": str(e)}


#: What the reader gives: the fields, with the body as text besides.
COLUMNS = tuple(x for n, _ in FIELDS for x in ((n, "payload") if n == "body" else (n,)))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in FIELDS], [n for n, _ in FIELDS])


def read_archives(files: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """Rows of ``COLUMNS`` from (path, content) rows, as the ``binaryFile`` source gives them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, size = [], 0
                for row in records(path, content.as_py() or b""):
                    held.append(row)
                    size += len(row.get("body") or b"") + 200
                    if size >= batch_bytes:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    text = F.col("body").cast("string")
    return files.select("path", "content").mapInArrow(run, SCHEMA).withColumn("payload", F.when(F.is_valid_utf8(text), text)).select(*COLUMNS)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The records of all .warc.zst files of a folder."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path))


def train_dictionary(pages: DataFrame, sample: int = 512, size: int = 64 << 10, id_col: str = "page_id", html_col: str = "html") -> bytes:
    """A zstandard dictionary from at most ``sample`` pages (those with the smallest hashes of id and text); empty if they are too few."""
    rows = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).where("length(h) > 0")
    # ids first: a task's share of a sorted limit goes to the driver whole
    picked = rows.select("i", F.xxhash64("i", "h").alias("k")).orderBy("k", "i").limit(sample).select("k")
    chosen = rows.withColumn("k", F.xxhash64("i", "h")).join(F.broadcast(picked), "k", "left_semi").dropDuplicates(["k"]).select(F.substring("h", 1, 8192).alias("h")).orderBy("h").collect()
    try:
        return zstandard.train_dictionary(size, [r.h.encode() for r in chosen]).as_bytes() if len(chosen) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def format_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC/1.1 response record with a page as its HTTP body."""
    body = None if html is None else html.encode()
    block = b"" if body is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%s" % (len(body), body)
    name = hashlib.md5(repr((page_id, url)).encode()).hexdigest()
    lines = [
        "WARC/1.1", f"WARC-Type: {'metadata' if body is None else 'response'}", f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>", "WARC-Date: 2024-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {url}"]), *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, dictionary: bytes = b"", archive_bytes: int = 8 << 20, level: int = 3, compress_dictionary: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(path, content) rows of archives of about ``archive_bytes``, one frame for each page, without a shuffle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, lead = TaskContext.get().partitionId(), 0, b""
        options: dict = {"level": level, "write_checksum": True}
        if dictionary:
            options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
            content = zstandard.ZstdCompressor(level=19).compress(dictionary) if compress_dictionary else dictionary
            lead = struct.pack("<II", DICT_MAGIC, len(content)) + content
        zstd, frames, size = zstandard.ZstdCompressor(**options), [lead], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:04d}.warc.zst"]), pa.array([b"".join(frames)], pa.binary())], ["path", "content"])

        for batch in batches:
            for page in zip(*(batch.column(c).to_pylist() for c in "iuh")):
                frames.append(zstd.compress(format_record(*page)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield row()
                    frames, size, number = [lead], 0, number + 1
        if size:
            yield row()

    return pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInArrow(run, "path string, content binary")


def save(archives: DataFrame, folder: str) -> None:
    """Write (path, content) rows as files into ``folder`` through the file system that its scheme names.

    Each task writes its own files under a temporary name and renames them, so a
    task that runs again replaces its files.
    """
    import os
    from urllib.parse import urlparse

    parsed = urlparse(folder)
    if parsed.scheme not in ("", "file"):
        raise ValueError("archives are written by file path: mount the shared folder, or write the rows as Parquet")
    os.makedirs(parsed.path, exist_ok=True)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                target = os.path.join(parsed.path, name)
                own = f"{target}.{os.getpid()}"
                with open(own, "wb") as f:
                    f.write(content.as_buffer())
                os.replace(own, target)
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    archives.mapInArrow(run, "path string").count()
