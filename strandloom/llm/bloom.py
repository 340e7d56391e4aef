"""A Bloom bitmap of fixed size over 64-bit hashes: what is broadcast doesn't grow with the data.

It can only let too much through, so an exact join follows wherever it is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import tidy

BITS, PIECE = 26, 16


def bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def bitmap(table: DataFrame) -> np.ndarray:
    """The bitmap of all ``h`` of a table; it reaches the driver in pieces of bytes, 2**BITS / 8 at most."""
    high = F.shiftrightunsigned("h", 64 - BITS)
    low = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    bit = table.select(F.explode(F.array(high, low)).alias("b"))
    words = bit.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            w, m = np.asarray(batch.column("w")), np.asarray(batch.column("m"))
            for piece in np.unique(w >> PIECE):
                own = pieces.setdefault(int(piece), np.zeros(1 << PIECE, dtype=np.int64))
                mine = w >> PIECE == piece
                own[w[mine] & ((1 << PIECE) - 1)] = m[mine]
        for piece, own in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([own.tobytes()], pa.binary())], ["piece", "words"])

    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    for r in words.repartition(F.shiftright("w", PIECE)).mapInArrow(pack, "piece long, words binary").collect():
        out[r.piece << PIECE : (r.piece + 1) << PIECE] = np.frombuffer(r.words, dtype=np.int64)
    return out.view(np.uint8)


def probe(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where the hashes are that may be in the table."""
    first, second = bits(h)
    found = np.flatnonzero((bitmap[first >> 3] >> (first & 7).astype(np.uint8)) & 1)
    second = second[found]
    return found[((bitmap[second >> 3] >> (second & 7).astype(np.uint8)) & 1) == 1]
