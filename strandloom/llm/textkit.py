"""Vectorised text kernels shared by the operators that need Python.

A *token* is a maximal run of ASCII letters, ASCII digits or non-ASCII
characters of the lower-cased text; everything else separates tokens.  In
regular-expression form: ``[a-z0-9\\u0080-\\U0010ffff]+`` over ``lower(text)``.

The kernels work on the UTF-8 bytes of a whole batch of texts at once, so the
cost is a few numpy passes per byte and no per-token Python.  A token's hash is
its polynomial value modulo 2**64 taken from one prefix sum over the batch, put
through a finaliser; equal tokens get equal hashes in every batch, process and
run.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled by one kernel call; bounds the temporaries (about 20 bytes each).
CHUNK_BYTES = 1 << 20
#: Bytes hashed at once within a call; bounds the table of powers and the prefix sums (about 40 bytes each).
SPAN_BYTES = 1 << 17

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = True
WORD[97:123] = True
WORD[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, base, dtype=U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]

    def shrink(self) -> None:
        """Forget what a span longer than usual made necessary."""
        self.up, self.down = self.up[: 2 * SPAN_BYTES].copy(), self.down[: 2 * SPAN_BYTES].copy()


_POWERS = _Powers(_BASE)
_POWERS2 = _Powers(0xD6E8FEB86659FD93)


def release() -> None:
    """Give back to the system what a task leaves in this worker: workers live on and take other tasks."""
    for powers in (_POWERS, _POWERS2):
        powers.shrink()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that cleans up after itself."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash the spans ``data[starts[i]:ends[i]]``, given in order; equal spans get equal hashes.

    Neighbouring spans share a prefix sum of about ``SPAN_BYTES``, so that only
    a longer span needs more memory.
    """
    out = np.empty(len(starts), dtype=U64)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, low + SPAN_BYTES, side="right")))
        part = data[low : int(ends[b - 1])].astype(U64)
        up, down = (_POWERS2 if second else _POWERS).to(len(part) + 1)
        total = np.empty(len(part) + 1, dtype=U64)
        total[0] = 0
        part += U64(1)
        part *= up[:-1]
        np.cumsum(part, out=total[1:])
        at = starts[a:b] - low
        out[a:b] = mix64((total[ends[a:b] - low] - total[at]) * down[at])
        a = b
    return out


class Tokens:
    """Tokens of a batch: hashes, byte spans in ``data``, and ``offsets`` by text."""

    __slots__ = ("data", "ends", "hashes", "offsets", "starts")

    def __init__(self, texts: list[str | None]) -> None:
        lowered = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
        self.data = data = np.frombuffer(b"\n".join(lowered) + b"\n", dtype=np.uint8)
        word = WORD[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.hashes = span_hashes(data, self.starts, self.ends)
        ends = np.cumsum([len(x) + 1 for x in lowered])
        self.offsets = np.concatenate(([0], np.searchsorted(self.starts, ends)))

    def text_of(self) -> np.ndarray:
        """The number of the text that each token belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` tokens that stay inside one text, and their text numbers."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:n] == text[k - 1 :]
    at = np.flatnonzero(inside)
    value = np.zeros(n, dtype=U64)
    for i in range(k):
        value *= U64(_BASE)
        value += hashes[i : i + n]
    return mix64(value[at]), text[at]


def unique_by_text(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, sorted by text and then by value."""
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    if len(values):
        keep = np.ones(len(values), dtype=bool)
        keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        values, text = values[keep], text[keep]
    return values, text


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-token shingles of one text."""
    tokens = Tokens([text])
    return np.unique(windows(tokens.hashes, tokens.offsets, k)[0])


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, *more: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column``, with ``more`` ones, has about ``limit`` bytes in each; a longer text stands alone."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for name in (column, *more):
            sizes += np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), dtype=np.int64)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_int64(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers, which Spark can store."""
    return values.view(np.int64)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat int64 ``values`` cut into rows of ``lengths``."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
