"""Near-duplicate documents by a MinHash containment ensemble.

The relation: text Q is contained in a text X that comes before it in the order
(more shingles first, then the smaller text hash) if at least ``threshold`` of
Q's distinct ``k``-token shingles occur in X.  Two texts that hold each other to
the threshold are near-duplicates; groups are the connected components of
these, to which a text contained in larger ones only is joined through the
first of them.  The first text of a group stays.

1. One pass of Python hashes each text: a hash of its whole token sequence
   (texts with equal tokens are exact copies and continue as one) and its
   distinct shingles.  These go by stretches of hashes, packed, to tasks that
   count in how many texts each occurs; what only one text has goes no further,
   the rest goes back to its texts.
2. Whatever holds the threshold of a text holds one of its
   ``floor((1 - t) * n) + 1`` rarest shingles, so a text asks for these.  Most
   texts have more than that for themselves and ask for nothing.
3. Ensemble: of the shingles that a text asks for, those with the smallest
   hashes are its MinHash buckets.  Texts are partitioned by shingle-set size,
   [2^p, 2^(p+1)); for each pair of partitions the containment threshold is
   converted to the Jaccard threshold ``t*q / (q + x - t*q)`` at the pair's
   extreme sizes, ``max_ratio`` at most apart, and the number of buckets is the
   least ``b`` with ``1 - (1 - s)^b >= recall``.  In each, a text first meets
   the first text that has the shingle, the first of its own size partition and
   its predecessor in the order; that puts most copies of one original into one
   group at the cost of three candidates a bucket.
4. The rest is exact: each text meets all that have any shingle it asks for, at
   any ratio of sizes, without a cap.  Only what can't change a group is left
   out: two texts of one group that was found from texts that hold each other,
   and texts too large to be held in return that come after the first in which
   the text was found to be contained.
5. Bitmaps of 256 bits rule out most pairs that only share a passage; the other
   candidates are checked exactly on the shingles that texts share with any
   other (the hashes have 48 bits and their stretch's number).
6. Groups are found by hooking each text to the first of its neighbours and
   following the pointers: in one task up to a million edges, beyond by all, again
   on what the edges contract to until none is left.

Cases: a null text or one without tokens is never a duplicate.  A text of
fewer than ``k`` tokens has no shingles and only has exact copies.  Of exact
copies the row with the smallest id stays (null ids last, then by text hash);
of wholly repeated rows (same id, same text) one stays.  An empty table gives
an empty result.  Only the id and text columns are read; others, whatever
their names, are kept as they are by :func:`keep_one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.shared import written
from ..sinks import files
from . import bloom
from .plan import cut, small, text_key
from .textkit import Tokens, as_int64, chunks, list_array, mix64, span_hashes, tidy, unique_by_text, windows

#: Rows of two numbers that are broadcast at most: about 40 MB in the driver.
BROADCAST = 200_000
#: Shingles of a stretch that are counted at once: about 60 bytes each in a worker.
AT_ONCE = 1 << 21
BLOBS = "b int, meta boolean, v binary, w binary, x binary, y binary, z binary"
RESULT = "doc_id long, duplicate_of long, containment double"


def jaccard_of(containment: float, query: float, size: float) -> float:
    """The Jaccard similarity of sets of sizes ``query`` and ``size`` at this containment of the first."""
    shared = containment * query
    return shared / (query + size - shared)


def bands(parts: int, threshold: float, recall: float, max_ratio: float) -> np.ndarray:
    """Bands emitted by each partition: the largest number tuned for a pair that it takes part in."""
    need = np.ones(parts, dtype=np.int64)
    for small in range(parts):
        for large in range(small, parts):
            low, high = float(1 << small), float((1 << (large + 1)) - 1)
            if large > small and (1 << large) / ((1 << (small + 1)) - 1) >= max_ratio:
                continue
            s = jaccard_of(threshold, min(low, high), min(high, low * 2 * max_ratio))
            b = math.ceil(math.log(1 - recall) / math.log(1 - s))
            need[small], need[large] = max(need[small], b), max(need[large], b)
    return need


def _hash_parts(docs: DataFrame) -> int:
    """Parts of the texts; they grow with the session's partitions."""
    return max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 16))


def _stretches(parts: int) -> int:
    """Stretches of hashes that are counted each by a task of its own.

    A text is named in each stretch in which it has a shingle, so stretches are
    long: in hundreds of them the names would take more room than the shingles.
    """
    return min(parts, max(48, -(-parts // 4)))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(keys[0]):
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _joined(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["b", "meta", "v", "w", "x", "y", "z"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """The blobs of each part of a task: its rows of documents and its others."""
    parts: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for b, meta, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            parts.setdefault(b, ([], []))[0 if meta else 1].append(blobs)
    while parts:
        b = next(iter(parts))
        yield b, *parts.pop(b)  # kept by the caller alone


def _hashed(docs: DataFrame, k: int, parts: int) -> DataFrame:
    """``BLOBS``: texts' rows, with the stretch ``b`` that passes them on to their parts, and shingles, by their stretch ``b``."""
    stretches = _stretches(parts)

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            tokens = Tokens(batch.column("t").to_pylist())
            some = np.flatnonzero(np.diff(tokens.offsets))
            if not len(some):
                continue
            u = np.zeros(batch.num_rows, dtype=np.uint64)
            u[some] = span_hashes(tokens.hashes, tokens.offsets[:-1][some], tokens.offsets[1:][some])
            values, text = unique_by_text(*windows(tokens.hashes, tokens.offsets, k))
            n = np.bincount(text, minlength=batch.num_rows).astype(np.int32)
            out = []
            ids, tk = batch.column("i"), np.asarray(batch.column("tk"))
            null, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
            to = u[some] % np.uint64(parts) % np.uint64(stretches)
            for b in np.unique(to):
                at = some[to == b]
                out.append((int(b), True, u[at].tobytes(), n[at].tobytes(), ids[at].tobytes(), tk[at].tobytes(), null[at].tobytes()))
            part = (values >> np.uint64(48)) % np.uint64(stretches)
            order = np.argsort(part, kind="stable")
            values, text, part = values[order], text[order], part[order]
            low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint16)
            runs = _runs(part, text)
            first, counts = runs[:-1], np.diff(runs).astype(np.int32)
            edge = _runs(part[first]) if len(first) else []
            for a, z in zip(edge[:-1], edge[1:]):
                at, ends = text[first[a:z]], slice(runs[a], runs[z])
                out.append((int(part[runs[a]]), False, u[at].tobytes(), counts[a:z].tobytes(), low[ends].tobytes(), high[ends].tobytes(), b""))
            yield _packed(out)

    return docs.where("t IS NOT NULL").select("i", text_key(F.col("t")).alias("tk"), "t").mapInArrow(split, BLOBS)


def _sets(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(u, n, i, tk, s, p) of each text with tokens: token-sequence hash, shingles, its rows, the shingles that other texts have, too.

    ``s`` has the rarest first; the first ``p`` of them and the shingles that no
    other text has are the ``floor((1 - t) * n) + 1`` rarest.  Hashes travel as
    blobs, by stretches of hashes to be counted and by ``u`` to be put together.
    """
    parts = _hash_parts(docs)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, metas, others in _by_part(batches):
            if metas:
                own = [_joined(x, kind) for x, kind in zip(zip(*metas), ("<u8", "<i4", "<i8", "<i8", "?"))]
                part = own[0] % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                edge = _runs(part[order])
                yield _packed([(int(part[order[a]]), True, *(x[order[a:z]].tobytes() for x in own)) for a, z in zip(edge[:-1], edge[1:])])
            if not others:
                continue
            u, counts, low, high = (_joined(x, kind) for x, kind in zip(zip(*others), ("<u8", "<i4", "<u4", "<u2")))
            del others
            once = np.zeros(len(u), dtype=bool)  # exact copies count as one text
            once[np.unique(u, return_index=True)[1]] = True
            run = np.repeat(np.arange(len(u), dtype=np.int32), counts)
            shared, pieces = [], -(-len(run) // AT_ONCE)
            for piece in range(pieces):
                at = np.flatnonzero((high.astype(np.uint32) * np.uint32(pieces) >> np.uint32(16) == piece) & once[run])
                h = low[at].astype(np.uint64) | high[at].astype(np.uint64) << np.uint64(32)
                order = np.argsort(h)
                at, h = run[at[order]], h[order]
                df = np.diff(_runs(h))
                df = np.repeat(df, df).astype(np.uint32)
                keep = df > 1
                shared.append((at[keep], mix64(h[keep] | np.uint64(b << 48)), df[keep]))
            del low, high, once, run, at, order, keep
            run, h, df = (np.concatenate(x) for x in zip(*shared))
            del shared
            part = (u % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((run, part[run]))
            run, h, df = run[order], h[order], df[order]
            del order
            to = part[run]
            edge = _runs(to)
            for a, z in zip(edge[:-1], edge[1:]):
                runs = _runs(run[a:z])
                at = run[a:z][runs[:-1]]
                yield _packed([(int(to[a]), False, u[at].tobytes(), np.diff(runs).astype(np.int32).tobytes(), h[a:z].tobytes(), df[a:z].tobytes(), b"")])

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, metas, others in _by_part(batches):
            if not metas:
                continue
            u, n, ids, tk, null = (_joined(x, kind) for x, kind in zip(zip(*metas), ("<u8", "<i4", "<i8", "<i8", "?")))
            order = np.lexsort((tk, ids, null, u))
            u, n, ids, tk, null = u[order], n[order], ids[order], tk[order], null[order]
            rows = _runs(u)
            one, n = u[rows[:-1]], n[rows[:-1]]
            whose, h, df = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint32)
            if others:
                v, counts, h, df = (_joined(x, kind) for x, kind in zip(zip(*others), ("<u8", "<i4", "<u8", "<u4")))
                whose = np.repeat(v, counts)
                order = np.lexsort((h, df, whose))
                whose, h = whose[order], h[order]
            low, high = np.searchsorted(whose, one), np.searchsorted(whose, one, side="right")
            shared = high - low
            rarest = np.floor((1 - threshold) * n + 1e-6).astype(np.int64) + 1
            p = np.clip(rarest - (n - shared), 0, shared).astype(np.int32)
            sizes = np.cumsum(shared + np.diff(rows))
            a = 0
            while a < len(one):
                z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + (1 << 18), side="right")))
                own = slice(rows[a], rows[z])
                some = np.diff(rows)[a:z]
                offsets = pa.array(np.concatenate(([0], np.cumsum(some))).astype(np.int32))
                listed = [pa.ListArray.from_arrays(offsets, pa.array(ids[own], mask=null[own])), pa.ListArray.from_arrays(offsets, pa.array(tk[own]))]
                yield pa.RecordBatch.from_arrays([pa.array(as_int64(one[a:z])), pa.array(n[a:z]), *listed, list_array(as_int64(h[low[a] : high[z - 1]]), shared[a:z]), pa.array(p[a:z])], ["u", "n", "i", "tk", "s", "p"])
                a = z

    counted = _hashed(docs, k, parts).repartitionById(_stretches(parts), F.col("b")).mapInArrow(count, BLOBS)
    return counted.repartitionById(parts, F.col("b")).mapInArrow(gather, "u long, n int, i array<long>, tk array<long>, s array<long>, p int")


def _places(sets: DataFrame, need: np.ndarray) -> DataFrame:
    """(h, u, n, q, l) of the texts' shingles that some text asks for: whether this one does, and in which it meets leaders.

    Behind a Bloom bitmap of fixed size; what it lets through needlessly, no text asks for.
    """
    asked = sets.where("p > 0").select(F.explode(F.slice("s", F.lit(1), F.col("p"))).alias("h"))
    bitmap = sets.sparkSession.sparkContext.broadcast(bloom.bitmap(asked))

    @tidy
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s")
            h, sizes = s.flatten().to_numpy().view(np.uint64), np.asarray(pc.list_value_length(s))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[row]
            asks = at < np.asarray(batch.column("p"))[row]
            n = np.asarray(batch.column("n"))
            mine = np.flatnonzero(asks)
            mine = mine[np.lexsort((h[mine], row[mine]))]
            ends = _runs(row[mine])
            leads = np.zeros(len(h), dtype=bool)
            if len(mine):
                rank = np.arange(len(mine)) - np.repeat(ends[:-1], np.diff(ends))
                leads[mine] = rank < need[np.log2(np.maximum(n, 1)).astype(int)][row[mine]]
            found = bloom.probe(bitmap.value, h)
            yield pa.RecordBatch.from_arrays([pa.array(as_int64(h[found])), batch.column("u").take(pa.array(row[found])), pa.array(n[row[found]]), pa.array(asks[found]), pa.array(leads[found])], ["h", "u", "n", "q", "l"])

    return sets.where("size(s) > 0").select("u", "n", "s", "p").mapInArrow(places, "h long, u long, n int, q boolean, l boolean")


def _led(places: DataFrame) -> DataFrame:
    """Distinct pairs (q, x) to compare first; x comes before q in the order."""
    rows = places.withColumn("p", (-F.floor(F.log2("n"))).cast("int")).repartition("h")
    bucket, part = W.partitionBy("h").orderBy("p", F.col("n").desc(), "u"), W.partitionBy("h", "p").orderBy(F.col("n").desc(), "u")
    met = rows.select("u", "l", F.first("u").over(bucket).alias("a"), F.lag("u").over(bucket).alias("b"), F.first("u").over(part).alias("c")).where("l AND a <> u")
    return met.select(F.col("u").alias("q"), F.explode(F.array("a", "b", "c")).alias("x")).where("q <> x").distinct()


def _rest(places: DataFrame, groups: DataFrame, found: DataFrame, done: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (q, x), x before q, of all that share a shingle that q asks for and that can still change a group.

    These are the pairs of two groups (u, root) that may hold each other, and
    those whose x comes before the first text in which q has been ``found``.
    """
    state = found.groupBy("q").agg(F.min(F.struct((-F.col("nx")).alias("o"), "x")).alias("f")).select(F.col("q").alias("u"), (-F.col("f.o")).alias("fn"), F.col("f.x").alias("fx"))
    state = cut(state.join(groups, "u", "full"))
    rows = places.join(small(state, BROADCAST), "u", "left").select("h", "u", "n", "q", "fn", "fx", F.coalesce("root", "u").alias("r")).repartition("h")
    bucket = W.partitionBy("h")
    rows = rows.select("*", F.min("r").over(bucket).alias("lo"), F.max("r").over(bucket).alias("hi"), F.min(F.struct((-F.col("n")).alias("o"), "u")).over(bucket).alias("top"))
    early = lambda n, x: f"(fx IS NULL OR {n} > fn OR {n} = fn AND {x} < fx)"
    q = rows.where(f"q AND top.u <> u AND (lo <> hi OR {early('-top.o', 'top.u')})").select("h", F.col("u").alias("q"), "n", "r", "fn", "fx")
    x = rows.select("h", F.col("u").alias("x"), F.col("n").alias("nx"), F.col("r").alias("rx"))
    pairs = q.join(x, "h").where(f"(nx > n OR nx = n AND x < q) AND (r <> rx AND nx * {threshold - 1e-9!r}D <= n OR {early('nx', 'x')})").select("q", "x").distinct()
    return pairs.join(done, ["q", "x"], "left_anti")


def _possible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (q, x) in which x may hold ``threshold`` of q's shingles, by 256 bits of each text in place of its shingles.

    A bit that q's shingles set and x's don't stands for one at least that x
    doesn't hold, and what q has for itself x doesn't hold either.
    """

    @tidy
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s")
            h, sizes = s.flatten().to_numpy().view(np.uint64), np.asarray(pc.list_value_length(s))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            words = np.zeros((batch.num_rows, 4), dtype=np.uint64)
            np.bitwise_or.at(words, (row, (h >> np.uint64(6) & np.uint64(3)).astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("n"), pa.array(sizes), *(pa.array(as_int64(words[:, j].copy())) for j in range(4))], ["u", "n", "m", "b0", "b1", "b2", "b3"])

    mark = sets.where("size(s) > 0").select("u", "n", "s").mapInArrow(marks, "u long, n int, m int, b0 long, b1 long, b2 long, b3 long")
    q, x = mark.toDF("q", "n", "m", "q0", "q1", "q2", "q3"), mark.drop("n", "m").toDF("x", "x0", "x1", "x2", "x3")
    missed = " + ".join(f"bit_count(q{j} & ~x{j})" for j in range(4))
    return pairs.join(q, "q").join(x, "x").where(f"m - ({missed}) >= {threshold - 1e-9!r}D * n").select("q", "x")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(q, x, nx, c, back) of the pairs in which x holds at least ``threshold`` of q's shingles; ``back`` is the share of x's in q."""

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            both = np.zeros(batch.num_rows)
            lists = {name: (s.values.to_numpy().view(np.uint64), s.offsets.to_numpy()) for name, s in (("q", batch.column("qs")), ("x", batch.column("xs")))}
            for row, (q, x) in enumerate(zip(batch.column("q").to_pylist(), batch.column("x").to_pylist())):
                if held > 1 << 21:  # members of one group come again and again
                    known, held = {}, 0
                for name, u in (("q", q), ("x", x)):
                    if u not in known:
                        values, offsets = lists[name]
                        known[u] = np.sort(values[offsets[row] : offsets[row + 1]])
                        held += len(known[u])
                mine, shingles = known[q], known[x]
                at = np.minimum(np.searchsorted(shingles, mine), len(shingles) - 1)
                both[row] = (shingles[at] == mine).sum()
            c, back = both / np.asarray(batch.column("nq")), both / np.asarray(batch.column("nx"))
            out = pa.RecordBatch.from_arrays([batch.column("q"), batch.column("x"), batch.column("nx"), pa.array(c), pa.array(back)], ["q", "x", "nx", "c", "back"])
            yield out.filter(pa.array(c >= threshold))

    used = small(cut(pairs.select(F.explode(F.array("q", "x")).alias("u")).distinct()), BROADCAST)
    mine = sets.select("u", "n", "s").join(used, "u", "left_semi")
    q, x = mine.select(F.col("u").alias("q"), F.col("n").alias("nq"), F.col("s").alias("qs")), mine.select(F.col("u").alias("x"), F.col("n").alias("nx"), F.col("s").alias("xs"))
    return pairs.join(q, "q").join(x, "x").select("q", "x", "nq", "nx", "qs", "xs").mapInArrow(check, "q long, x long, nx int, c double, back double")


def _edges(verified: DataFrame, threshold: float) -> DataFrame:
    """(q, x, nx) of the pairs that make groups: near-duplicates, and for each text the first that it is contained in."""
    first = verified.groupBy("q").agg(F.min(F.struct((-F.col("nx")).alias("o"), "x")).alias("b")).select("q", F.col("b.x").alias("x"), (-F.col("b.o")).alias("nx"))
    return verified.where(F.col("back") >= threshold).select("q", "x", "nx").union(first.select("q", "x", "nx")).distinct()


def _jumped(pointers: DataFrame) -> DataFrame:
    """(u, nu, x, nx) with the pointers followed to their end, doubling the step in each round."""
    found = pointers
    while True:
        nxt = found.select(F.col("u").alias("x"), F.col("x").alias("y"), F.col("nx").alias("ny"))
        found = cut(found.join(nxt, "x", "left").select("u", "nu", F.coalesce("y", "x").alias("x"), F.coalesce("ny", "nx").alias("nx"), F.col("y").isNotNull().alias("moved")))
        if found.where("moved").isEmpty():
            return found.drop("moved")


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of the nodes ``a`` and ``b``, edge by edge; ``root`` has the first node of each node's tree."""
    a, b = root[a], root[b]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root[root], root):
            root[:] = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]


def _roots_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The roots of all edges in one task."""
    parts = [np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("q", "nq", "x", "nx")]) for batch in batches]
    if not parts:
        return
    q, nq, x, nx = np.concatenate(parts, axis=1)
    u, at = np.unique(np.concatenate((q, x)), return_index=True)
    order = np.lexsort((u, -np.concatenate((nq, nx))[at]))
    rank = np.empty(len(u), dtype=np.int64)
    rank[order] = np.arange(len(u))
    a, b = rank[np.searchsorted(u, q)], rank[np.searchsorted(u, x)]
    root = np.arange(len(u))
    join(root, a, b)
    moved = np.flatnonzero(root != np.arange(len(u)))
    yield pa.RecordBatch.from_arrays([pa.array(u[order[moved]]), pa.array(u[order[root[moved]]])], ["u", "root"])


def _roots(edges: DataFrame, here: int = 1_000_000) -> DataFrame:
    """(u, root) of all texts with an edge (q, nq, x, nx): the first text of their component in the order; roots of themselves are left out.

    Up to ``here`` edges are one task's, more are followed in rounds by all.
    """
    if edges.count() <= here:
        return edges.coalesce(1).mapInArrow(tidy(_roots_here), "u long, root long")
    known = None
    while True:
        both = edges.select(F.col("q").alias("u"), F.col("nq").alias("nu"), "x", "nx").union(edges.select(F.col("x").alias("u"), F.col("nx").alias("nu"), F.col("q").alias("x"), F.col("nq").alias("nx")))
        hooked = both.where("nx > nu OR nx = nu AND x < u").groupBy("u", "nu").agg(F.min(F.struct((-F.col("nx")).alias("o"), "x")).alias("b"))
        step = _jumped(hooked.select("u", "nu", F.col("b.x").alias("x"), (-F.col("b.o")).alias("nx")))
        if known is None:
            known = step.select("u", F.col("x").alias("root"))
        else:
            after = step.select(F.col("u").alias("root"), F.col("x").alias("later"))
            known = cut(known.join(after, "root", "left").select("u", F.coalesce("later", "root").alias("root")).unionByName(step.select("u", F.col("x").alias("root"))))
        q = step.select(F.col("u").alias("q"), F.col("x").alias("rq"), F.col("nx").alias("nrq"))
        x = step.select(F.col("u").alias("x"), F.col("x").alias("rx"), F.col("nx").alias("nrx"))
        moved = edges.join(q, "q", "left").join(x, "x", "left").select(F.coalesce("rq", "q").alias("q"), F.coalesce("nrq", "nq").alias("nq"), F.coalesce("rx", "x").alias("x"), F.coalesce("nrx", "nx").alias("nx"))
        edges = cut(moved.where("q <> x").distinct())
        if edges.isEmpty():
            return known


#: Connected components, for other operators.
components = _roots


def near_duplicates(docs: DataFrame, threshold: float = 0.65, k: int = 4, recall: float = 0.97, max_ratio: float = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, tk, head_i, head_tk, c, repeats): each row of a group, and the row of it that stays.

    ``tk`` is the text's key (see ``plan.text_key``), ``c`` the largest verified
    containment of the text in another of its group (1 for exact copies),
    ``repeats`` the number of rows that equal the one that stays.
    """
    own = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    sets, path = written(_sets(own, k, threshold), "sets")
    places, asked = written(_places(sets, bands(40, threshold, recall, max_ratio)), "places")
    heads = sets.select("u", "n", F.element_at("i", 1).alias("head_i"), F.element_at("tk", 1).alias("head_tk"), F.size("i").alias("rows"))
    sizes = heads.select(F.col("u").alias("q"), F.col("n").alias("nq"))

    def grouped(edges: DataFrame) -> DataFrame:
        return cut(_roots(cut(edges.join(sizes, "q"))))

    led = cut(_led(places))
    found = cut(_verified(led, sets, threshold))
    # what holds each other stays in one group, whatever else is found
    sure = grouped(found.where(F.col("back") >= threshold).select("q", "x", "nx"))
    rest = cut(_possible(_rest(places, sure, found, led, threshold), sets, threshold))
    found = cut(found.unionByName(_verified(rest, sets, threshold)))
    roots = grouped(_edges(found, threshold))
    best = found.select(F.col("q").alias("u"), "c").union(found.select("x", F.col("back").alias("c"))).groupBy("u").agg(F.max("c").alias("c"))
    grown = roots.join(best, "u").unionByName(roots.select(F.col("root").alias("u"), "root", F.lit(1.0).alias("c")).distinct())
    tops = sets.join(small(cut(grown), BROADCAST), "u", "left").where("root IS NOT NULL OR size(i) > 1")
    tops = cut(tops.select("u", "i", "tk", F.coalesce("root", "u").alias("root"), F.coalesce("c", F.lit(1.0)).alias("c")))
    top = tops.where("u = root").select("root", F.element_at("i", 1).alias("head_i"), F.element_at("tk", 1).alias("head_tk"))
    rows = tops.join(top, "root").select(F.explode(F.arrays_zip("i", "tk")).alias("m"), "head_i", "head_tk", "c")
    out = rows.select("m.i", "m.tk", "head_i", "head_tk", "c")
    out = cut(out.groupBy("i", "tk", "head_i", "head_tk", "c").agg(F.count(F.lit(1)).alias("repeats")))
    for folder in (path, asked):
        files.delete(docs.sparkSession, folder)
    return out


def _is_head() -> F.Column:
    return F.col("i").eqNullSafe(F.col("head_i")) & (F.col("tk") == F.col("head_tk"))


def duplicates(docs: DataFrame, **options) -> DataFrame:
    """``RESULT``: each document that a group drops, the one that stays for it, and its containment."""
    found = near_duplicates(docs, **options).where(~_is_head())
    return found.select(F.col("i").alias("doc_id"), F.col("head_i").alias("duplicate_of"), F.col("c").alias("containment"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = cut(near_duplicates(docs, id_col=id_col, text_col=text_col, **options))
    out, repeated = found.where(~_is_head()).select("i", "tk"), found.where(_is_head() & (F.col("repeats") > 1)).select("i", "tk")
    names = docs.columns
    plain = [f"_c{n}" for n in range(len(names))]
    rows = docs.toDF(*plain)
    i, tk = F.col(plain[names.index(id_col)]).cast("long"), text_key(F.col(plain[names.index(text_col)]))
    same = i.eqNullSafe(F.col("i")) & (tk == F.col("tk"))
    kept = rows.join(small(out, BROADCAST), same, "left_anti")
    if repeated.isEmpty():
        return kept.toDF(*names)
    repeated = small(repeated, BROADCAST)
    once = kept.join(repeated, same, "left_semi").withColumn("_i", i).withColumn("_k", tk).dropDuplicates(["_i", "_k"]).drop("_i", "_k")
    return kept.join(repeated, same, "left_anti").unionByName(once).toDF(*names)
