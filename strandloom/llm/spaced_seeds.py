"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the tokens that a fixed mask selects in a window, so
substitutions at the ignored positions leave it unchanged.  Benchmark items and
documents are hashed with the same masks; equal hashes join to (document,
item, diagonal), and the overlap around each such hit is verified on the
tokens: along the diagonal, the stretch with the best score (+1 for an equal
token, -2 for a different one) must hold ``min_match`` equal tokens, or 80 % of
a shorter item, with an identity of at least ``min_identity``.

Only seeds that the benchmark may have leave the Python workers: they are
looked up in a Bloom bitmap of fixed size (8 MB) that is built from all
benchmark seeds.  It can only let too much through, so the join that follows is
exact at any benchmark size, and what is broadcast doesn't grow.

Items of under 17 tokens are too short for the masks to survive the
substitutions that verification accepts, so such an item has masks of its own
length: it is cut into two pieces more than it may have substitutions, and each
mask ignores as many pieces as that, which leaves one that no substitution hits.

Cases: null and empty texts and items match nothing.  Items under ``min_item``
tokens would match everywhere and are ignored.  Repeated rows and ids are told apart by row, null
ids are carried as null; equal items each report their own rows.  Empty tables
give an empty result.  Columns other than id and text aren't read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .plan import cut, small, text_key
from .textkit import Tokens, as_int64, chunks, list_array, mix64, tidy

#: Weight 6 in a span of 9 to 12: one of them survives any two substitutions in 15 tokens or more.
MASKS = ("111001011", "110100110001", "101110000111")
#: The least number of tokens from which the masks suffice.
ENOUGH = 17
RESULT = "doc_id long, item_id long, doc_start int, item_start int, n_tokens int, n_match int"


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds_by_mask(tokens: Tokens, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Seed hashes of all windows inside one text, their text numbers and token positions, a mask at a time."""
    text = tokens.text_of()
    for mask in masks:
        n = len(tokens.hashes) - len(mask) + 1
        if n <= 0:
            continue
        value = np.full(n, int(mask, 2) * 64 + len(mask), dtype=np.uint64)
        for i in _offsets(mask):
            value *= np.uint64(0xD6E8FEB86659FD93)
            value += tokens.hashes[i : i + n]
        at = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
        yield mix64(value[at]), text[at], at - tokens.offsets[text[at]]


def _together(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int)
    return tuple(np.concatenate(x) for x in zip(*parts))


def seeds(tokens: Tokens, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all masks."""
    return _together(list(seeds_by_mask(tokens, masks)))


def probed(tokens: Tokens, masks: tuple[str, ...], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seeds that the benchmark may have. Short items bring dozens of masks, so no more than one mask's seeds are held."""
    parts = []
    for h, text, at in seeds_by_mask(tokens, masks):
        found = bloom.probe(bitmap, h)
        parts.append((h[found], text[found], at[found]))
    return _together(parts)


def masks_of(n: int, min_match: int) -> tuple[str, ...]:
    """Masks of a short item's whole length: whatever substitutions it may have, one of them ignores all."""
    lost = n - needed(n, min_match)
    edges = [n * k // (lost + 2) for k in range(lost + 3)]
    out = []
    for gone in itertools.combinations(range(lost + 2), lost):
        out.append("".join("0" if any(edges[g] <= i < edges[g + 1] for g in gone) else "1" for i in range(n)))
    return tuple(out)


def needed(n: int, min_match: int) -> int:
    """Equal tokens that an overlap with an item of n tokens must have."""
    return min(min_match, math.ceil(0.8 * n))


def _short_masks(items: DataFrame, min_match: int, min_item: int) -> dict[int, tuple[str, ...]]:
    """The masks of each length of short items that there is."""

    @tidy
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            n = np.unique(np.diff(Tokens(batch.column("t").to_pylist()).offsets))
            yield pa.RecordBatch.from_arrays([pa.array(n[(n >= min_item) & (n < ENOUGH)].astype(np.int32))], ["n"])

    return {r.n: masks_of(r.n, min_match) for r in items.select("t").mapInArrow(lengths, "n int").distinct().orderBy("n").collect()}


def _seed_table(items: DataFrame, short: dict[int, tuple[str, ...]]) -> DataFrame:
    """(h, item, p) of all seeds of the items, by the masks or by those of their length."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            tokens = Tokens(batch.column("t").to_pylist())
            size = np.diff(tokens.offsets)
            parts = []
            for lengths, masks in (((ENOUGH, None), MASKS), *(((n, n), m) for n, m in short.items())):
                h, text, at = seeds(tokens, masks)
                fits = (size[text] >= lengths[0]) & (size[text] <= (lengths[1] or size.max(initial=0)))
                parts.append((h[fits], text[fits], at[fits]))
            h, text, at = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(as_int64(h)), batch.column("item").take(pa.array(text)), pa.array(at.astype(np.int32))], ["h", "item", "p"])

    return items.select("item", "t").mapInArrow(run, "h long, item long, p int")


def _segment(equal: np.ndarray) -> tuple[int, int]:
    """The stretch [a, b) with the best score, +1 for equal and -2 for different tokens."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    low = np.minimum.accumulate(total)
    b = int(np.argmax(total - low))
    return int(np.argmax(total[: b + 1] == low[b])), b


def overlaps(doc: np.ndarray, item: np.ndarray, diagonals: list[int], min_match: int, min_identity: float) -> tuple[int, int, int, int] | None:
    """The best verified overlap (doc start, item start, tokens, equal tokens) of two token arrays."""
    best = None
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        equal = item[lo:hi] == doc[lo + d : hi + d]
        a, b = _segment(equal)
        match = int(equal[a:b].sum())
        if match >= needed(len(item), min_match) and match >= min_identity * (b - a) and (best is None or match > best[3]):
            best = (lo + a + d, lo + a, b - a, match)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 13, min_identity: float = 0.75, min_item: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``RESULT`` plus the text key ``tk``: the best verified overlap of each document and item that overlap."""
    items = cut(benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("t")).where("t IS NOT NULL").withColumn("item", F.monotonically_increasing_id()))
    short = _short_masks(items, min_match, min_item)
    masks = (*MASKS, *itertools.chain.from_iterable(short.values()))
    table = cut(_seed_table(items, short))
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(bloom.bitmap(table))

    @tidy
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            tokens = Tokens(batch.column("t").to_pylist())
            h, text, at = probed(tokens, masks, bitmap.value)
            found = np.argsort(text, kind="stable")
            n = np.bincount(text, minlength=batch.num_rows)
            rows = np.flatnonzero(n)
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("t"), list_array(as_int64(h[found]), n[rows]), list_array(at[found].astype(np.int64), n[rows])], ["i", "t", "hs", "ps"])

    own = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    hits = cut(own.mapInArrow(probe, "i long, t string, hs array<long>, ps array<long>").withColumn("row", F.monotonically_increasing_id()))
    exploded = hits.select("row", F.explode(F.arrays_zip("hs", "ps")).alias("z")).select("row", F.col("z.hs").alias("h"), F.col("z.ps").alias("at"))
    # a seed that both sides have often: the benchmark's side is broadcast while it is small, and split by AQE beyond
    joined = exploded.join(small(table), "h").select("row", "item", (F.col("at") - F.col("p")).alias("d")).distinct()
    by_item = joined.groupBy("row", "item").agg(F.collect_list("d").alias("ds")).join(small(items.select("item", "item_id", F.col("t").alias("it")), 10_000), "item")
    # the items that one document meets come in parts, so that no row has to hold a whole benchmark
    by_row = by_item.groupBy("row", F.pmod(F.xxhash64("item"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("item", "item_id", "it", "ds")).alias("found"))

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            out = []
            for i, tk, t, found in zip(*(batch.column(c).to_pylist() for c in ("i", "tk", "t", "found"))):
                doc = Tokens([t]).hashes
                for x in sorted(found, key=lambda x: x["item"]):
                    best = overlaps(doc, Tokens([x["it"]]).hashes, sorted(x["ds"]), min_match, min_identity)
                    if best:
                        out.append((i, x["item_id"], *best, tk))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_match", "tk"])

    rows = hits.select("row", "i", "t", text_key(F.col("t")).alias("tk")).join(by_row.drop("part"), "row")
    return rows.select("i", "tk", "t", "found").mapInArrow(verify, RESULT + ", tk long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, with all their columns."""
    found = cut(contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("i"), "tk").distinct())
    names = docs.columns
    plain = [f"_c{n}" for n in range(len(names))]
    rows = docs.toDF(*plain)
    same = F.col(plain[names.index(id_col)]).cast("long").eqNullSafe(F.col("i")) & (text_key(F.col(plain[names.index(text_col)])) == F.col("tk"))
    return rows.join(small(found), same, "left_anti").toDF(*names)
