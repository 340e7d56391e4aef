"""Token-ID binary output: independent zstandard frames with a trailing seek table.

A shard is a sequence of zstandard frames and ends with a skippable frame that
holds the seek table of the public seekable format: for each frame its
compressed size, its decompressed size and the low 32 bits of the XXH64 of its
decompressed bytes, then the number of frames, a descriptor and the magic
0x8F92EAB1.  Frame 0 is the directory: ``TOKS``, the version and the bytes of a
token (uint16 each), then the document ids (little-endian int64); frame n + 1
holds the token ids of document n (little-endian uint16, or uint32 if the
vocabulary needs it).  A reader takes the table from the end of the shard and
decompresses only the frames that it wants; any zstandard tool decodes the whole.

Documents are encoded where they lie and in their order, so nothing is
shuffled; a shard is closed when it exceeds ``shard_bytes``, which bounds memory.
A shard's name has the run, the partition and its number in it, so a task that
runs again writes the same shards and other runs write others.

Encoding is exact byte-level BPE.  The tokenizer's pattern never joins a
character before a space with that space, so text is cut there and equal pieces
are encoded once per batch of texts and worker.

Cases: a null or empty text has an empty frame.  A null id is stored as the
smallest int64.  Repeated rows get a frame each.  An empty table gives no
shards.  Texts of any length have one frame.  Other columns aren't read.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import cut
from .textkit import chunks, span_hashes, tidy

SEEK_MAGIC, SKIPPABLE = 0x8F92EAB1, 0x184D2A5E
NULL_ID, DIRECTORY = -(1 << 63), b"TOKS"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = "shard string, n_docs long, n_tokens long, doc_ids array<long>, data binary"


class Encoder:
    """Byte-level BPE of whole batches; equal pieces are encoded once."""

    def __init__(self, path: str = TOKENIZER, most_pieces: int = 300_000) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)
        self.dtype = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        self.most = most_pieces
        self._forget()

    def _forget(self) -> None:
        self.known, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, self.dtype)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), dtype=self.dtype)

    def _pieces(self, data: bytes, starts: np.ndarray, ends: np.ndarray, joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all pieces, and where each piece's begin and how many they are."""
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        tokens = np.empty(0, self.dtype)
        run = np.flatnonzero(joinable)
        if len(run):
            joined = b"".join([data[a:b] for a, b in zip(starts[run].tolist(), ends[run].tolist())]).decode()
            tokens = np.array(self.bpe.encode_ordinary(joined), dtype=self.dtype)
            bounds, reach = np.cumsum(ends[run] - starts[run]), np.cumsum(self.bytes_of[tokens])
            stop = np.searchsorted(reach, bounds) + 1
            if (reach[stop - 1] == bounds).all():
                size[run] = np.diff(stop, prepend=0)
                at[run] = stop - size[run]
            else:
                joinable, tokens = np.zeros(len(starts), bool), np.empty(0, self.dtype)
        alone = np.flatnonzero(~joinable)
        parts = [self._plain(data[starts[k] : ends[k]].decode()) for k in alone]
        size[alone] = [len(x) for x in parts]
        at[alone] = len(tokens) + np.cumsum(size[alone]) - size[alone]
        return np.concatenate([tokens, *parts]), at, size

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and ``offsets`` by text."""
        raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        text_at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        if not len(data):
            return np.empty(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        before, lead = np.zeros_like(data), np.zeros_like(data)
        before[1:], lead[2:] = data[:-1], data[:-2]
        solid = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (lead == 0xC3))
        cut = (data == 0x20) & solid
        spaced = cut.copy()
        at = text_at[:-1][np.diff(text_at) > 0]
        cut[at], spaced[at] = True, False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        h, h2 = span_hashes(data, starts, ends), span_hashes(data, starts, ends, second=True)
        piece, first, which = np.unique(h, return_index=True, return_inverse=True)
        if (h2[first][which] != h2).any():  # two pieces with one hash: without the shortcut
            parts = [self._plain(t or "") for t in texts]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        if len(self.known) > self.most:
            self._forget()
        slot = np.searchsorted(self.known, piece)
        old = np.zeros(len(piece), bool)
        inside = slot < len(self.known)
        old[inside] = self.known[slot[inside]] == piece[inside]
        old[old] = self.check[slot[old]] == h2[first][old]
        new = np.flatnonzero(~old)
        if len(new):
            k = first[new]
            after = np.append(spaced, True)[ends[k]]  # a cut made at a solid character
            tokens, place, size = self._pieces(data.tobytes(), starts[k], ends[k], spaced[starts[k]] & after & (ends[k] < len(data)))
            place += len(self.pool)
            self.pool = np.concatenate((self.pool, tokens))
            self.known, self.check = np.insert(self.known, slot[new], piece[new]), np.insert(self.check, slot[new], h2[k])
            self.at, self.size = np.insert(self.at, slot[new], place), np.insert(self.size, slot[new], size)
            slot = np.searchsorted(self.known, piece)
        n, from_ = self.size[slot][which], self.at[slot][which]
        total = np.cumsum(n)
        ids = self.pool[np.repeat(from_ - (total - n), n) + np.arange(total[-1])]
        bounds = np.concatenate(([0], total))[np.searchsorted(starts, text_at)]
        return ids, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, with the pieces it has seen."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """Collects documents and closes them into one shard."""

    def __init__(self, level: int = 3, dtype: str | np.dtype = "<u2") -> None:
        self.dtype = np.dtype(dtype)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.ids: list[int] = []
        self.frames: list[bytes] = []
        self.entries: list[bytes] = []
        self.size = self.tokens = 0

    def _frame(self, payload: bytes) -> tuple[bytes, bytes]:
        frame = self.zstd.compress(payload)
        return frame, struct.pack("<III", len(frame), len(payload), xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF)

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        frame, entry = self._frame(tokens.astype(self.dtype, copy=False).tobytes())
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.frames.append(frame)
        self.entries.append(entry)
        self.size += len(frame) + len(entry)
        self.tokens += len(tokens)

    def close(self) -> bytes:
        frame, entry = self._frame(struct.pack("<4sHH", DIRECTORY, 1, self.dtype.itemsize) + np.array(self.ids, "<i8").tobytes())
        table = b"".join([entry, *self.entries])
        footer = struct.pack("<IBI", len(self.entries) + 1, 0x80, SEEK_MAGIC)
        return b"".join([frame, *self.frames, struct.pack("<II", SKIPPABLE, len(table) + len(footer)), table, footer])


def seek_table(data: bytes) -> np.ndarray:
    """Rows (offset, compressed size, decompressed size, checksum) of the frames of a shard, or of the end of one that has the whole table."""
    if len(data) < 17:
        raise ValueError("no seek table at the end of the shard")
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC or not descriptor & 0x80:
        raise ValueError("no seek table with checksums at the end of the shard")
    start = len(data) - 9 - 12 * n
    if start < 8 or struct.unpack("<II", data[start - 8 : start]) != (SKIPPABLE, 12 * n + 9):
        raise ValueError("the seek table's frame is damaged")
    entries = np.frombuffer(data[start:-9], dtype="<u4").reshape(n, 3).astype(np.int64)
    return np.column_stack((np.cumsum(entries[:, 0]) - entries[:, 0], entries))


def whole_table(data: bytes) -> np.ndarray:
    """The seek table of a whole shard, whose frames it must fit."""
    table = seek_table(data)
    if table[:, 1].sum() != len(data) - 17 - 12 * len(table):
        raise ValueError("the seek table doesn't fit the frames")
    return table


def _payload(packed: bytes, row: np.ndarray, k: int) -> bytes:
    """A frame's content, checked against its checksum."""
    size, check = int(row[2]), int(row[3])
    payload = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(size, 1))
    if len(payload) != size or xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF != check:
        raise ValueError(f"frame {k} is damaged")
    return payload


def read_frames(data: bytes, numbers: list[int]) -> list[bytes]:
    """Decompress only these frames, and check each against its checksum."""
    table = whole_table(data)
    return [_payload(data[int(table[k, 0]) : int(table[k, 0] + table[k, 1])], table[k], k) for k in numbers]


def directory(payload: bytes) -> tuple[np.ndarray, np.dtype]:
    """The document ids and the type of tokens that frame 0 names."""
    magic, version, width = struct.unpack_from("<4sHH", payload) if len(payload) >= 8 else (b"", 0, 0)
    if magic != DIRECTORY or version != 1 or width not in (2, 4):
        raise ValueError("no directory in the first frame")
    return np.frombuffer(payload, "<i8", offset=8), np.dtype(f"<u{width}")


def read_file(path: str, wanted: set[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, tokens) of a shard's file, or of the wanted ids in it; only the table's and these frames' bytes are read."""
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        f.seek(max(0, size - 9))
        tail = f.read(9)
        n = struct.unpack("<I", tail[:4])[0] if len(tail) == 9 else 0
        f.seek(max(0, size - 17 - 12 * n))
        table = seek_table(f.read())

        def frame(k: int) -> bytes:
            f.seek(int(table[k, 0]))
            return _payload(f.read(int(table[k, 1])), table[k], k)

        ids, dtype = directory(frame(0))
        for k in range(len(ids)) if wanted is None else np.flatnonzero(np.isin(ids, list(wanted))):
            yield None if ids[k] == NULL_ID else int(ids[k]), np.frombuffer(frame(int(k) + 1), dtype)


def save(shards: DataFrame, folder: str) -> DataFrame:
    """(path) of the shards' files, written into a mounted folder that all executors share, each under a temporary name first."""
    import os

    os.makedirs(folder, exist_ok=True)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [os.path.join(folder, f"{name}.tok.zst") for name in batch.column("shard").to_pylist()]
            for path, data in zip(paths, batch.column("data")):
                own = f"{path}.{os.getpid()}"
                with open(own, "wb") as f:
                    f.write(data.as_buffer())
                os.replace(own, path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return cut(shards.select("shard", "data").mapInArrow(run, "path string"))


def write_shards(docs: DataFrame, tokenizer: str = TOKENIZER, shard_bytes: int = 8 << 20, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``RESULT``: one row for each shard, with the whole of its bytes."""
    name = uuid.uuid4().hex[:12]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder = encoder_of(tokenizer)
        shard = ShardWriter(level, encoder.dtype)

        def row() -> pa.RecordBatch:
            values = [[f"{name}-{part:06d}-{number:04d}"], [len(shard.ids)], [shard.tokens], [[None if x == NULL_ID else x for x in shard.ids]], [shard.close()]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["shard", "n_docs", "n_tokens", "doc_ids", "data"])

        for batch in chunks(batches, "t"):
            ids, bounds = encoder.encode(batch.column("t").to_pylist())
            for k, doc_id in enumerate(batch.column("i").to_pylist()):
                shard.add(doc_id, ids[bounds[k] : bounds[k + 1]])
                if shard.size >= shard_bytes:
                    yield row()
                    number, shard = number + 1, ShardWriter(level, encoder.dtype)
        if shard.ids:
            yield row()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, RESULT)


def read_documents(shards: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, tokens) of all documents of the shards, or of those whose id is in ``wanted.doc_id``; other frames stay compressed."""
    rows = shards.select("shard", F.posexplode("doc_ids").alias("n", "doc_id"))
    if wanted is not None:
        rows = rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = rows.groupBy("shard").agg(F.sort_array(F.collect_list("n")).alias("ns"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ns, data in zip(batch.column("ns").to_pylist(), batch.column("data").to_pylist()):
                first, *frames = read_frames(data, [0, *(n + 1 for n in ns)])
                ids, dtype = directory(first)
                tokens = [np.frombuffer(x, dtype).astype(np.int32) for x in frames]
                yield pa.RecordBatch.from_arrays([pa.array([None if ids[n] == NULL_ID else int(ids[n]) for n in ns], pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return shards.select("shard", "data").join(asked, "shard").select("ns", "data").mapInArrow(run, "doc_id long, tokens array<int>")
