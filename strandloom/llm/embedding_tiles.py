"""Near-duplicate embeddings by PCA-ordered tiled comparison, exact over all pairs.

Vectors are normalised and rotated into the eigenvectors of their second
moments, largest first, so leading dimensions hold most of every product; the
rotation keeps cosines.  Tiles hold vectors that are neighbours in the leading
coordinates.  Two tiles are compared only if an upper bound from their
coordinates' ranges and largest suffix norms reaches the threshold.  Within a
pair of tiles, products are accumulated over the leading dimensions in steps;
after each step, a pair whose partial product plus the product of its two
suffix norms is below the threshold is dropped, and when few are left only
they are continued.  What remains is verified in double precision.

Tiles meet in the cells of a triangular grid of tile groups: the vectors of two
groups (``group_tiles`` tiles each) are all that a task holds.  Every pair of
tiles belongs to exactly one cell.  The bound comes first: from a few numbers of
each group, cells that can't reach the threshold are never made, and a tile goes
only to the cells of whose other group it may match something.  What is left is
quadratic in the worst case, directions without any structure.

Cases: vectors that are null, empty, zero, of another length than most, or that
hold a null, NaN or infinity have no direction and match nothing.  Pairs have the smaller
id first; vectors of the same id (repeated rows) aren't paired with each other,
other repeated rows give their pair once.  Ties at the threshold match.  Null
ids are left out.  An empty table gives an empty result.  Other columns aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containment_dedup import components, join
from .plan import cut, small
from .textkit import tidy

RESULT = "vec_a long, vec_b long, cosine double"
LINKED = "vec_id long, links long, first long"
CLASSES = "vec_id long, class_id long, links long"
SLACK = 2e-5
#: Groups of no more tiles than asked for are made while there are at most so many; beyond, they are joined up to so many bytes of vectors.
GROUPS, GROUP_BYTES = 12, 12 << 20
#: Products of a tile with others are made at once up to so many.
PRODUCTS = 1 << 20


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Eigenvectors of the second moments, by falling eigenvalue; only size x size sums leave a task."""

    @tidy
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column("e"), size)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        at = np.arange(size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total), pa.list_(pa.float64()))], ["r", "m"])

    parts = vectors.select("e").mapInArrow(moments, "r long, m array<double>")
    rows = parts.select("r", F.posexplode("m")).groupBy("r", "pos").agg(F.sum("col").alias("v")).toPandas()
    total = np.zeros((size, size))
    total[rows["r"], rows["pos"]] = rows["v"]
    values, axes = np.linalg.eigh(total)
    return axes[:, ::-1]


def _bounds(x: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ranges of the leading coordinates and the largest norm of the rest."""
    return x[:, :lead].min(0), x[:, :lead].max(0), float(np.sqrt((x[:, lead:] ** 2).sum(1)).max())


def reach(a: tuple, b: tuple) -> np.ndarray:
    """An upper bound of the products between two tiles, or between one and each of others."""
    ends = np.stack([a[0] * b[0], a[0] * b[1], a[1] * b[0], a[1] * b[1]])
    return ends.max(0).sum(-1) + a[2] * b[2]


def _reach_sql(lead: int, a: str, b: str) -> str:
    """:func:`reach` of two rows of bounds as an expression."""
    ends = lambda k: ", ".join(f"{a}.{p}[{k}] * {b}.{q}[{k}]" for p in ("lo", "hi") for q in ("lo", "hi"))
    return " + ".join([f"greatest({ends(k)})" for k in range(lead)] + [f"{a}.rest * {b}.rest"])


def tile_pairs(a: np.ndarray, b: np.ndarray, threshold: float, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two rotated float32 matrices that may reach the threshold, by leading dimensions and suffix norms."""
    done, goal = 0, np.float32(threshold - SLACK)
    total, i, j = None, None, None
    for stop in steps:
        sa, sb = np.sqrt((a[:, stop:] ** 2).sum(1)), np.sqrt((b[:, stop:] ** 2).sum(1))
        if i is None:
            part = a[:, done:stop] @ b[:, done:stop].T
            total = part if total is None else total + part
            open_ = total + sa[:, None] * sb[None, :] >= goal
            if open_.mean() < 0.02 or stop == steps[-1]:
                i, j = np.nonzero(open_)
                total = total[i, j]
        else:
            total = total + np.einsum("ij,ij->i", a[i, done:stop], b[j, done:stop])
            keep = total + sa[i] * sb[j] >= goal
            i, j, total = i[keep], j[keep], total[keep]
        done = stop
        if i is not None and not len(i):
            break
    return i, j


def _compared(vectors: DataFrame, linked: bool, threshold: float = 0.95, tile: int = 1024, group_tiles: int = 8, lead: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``RESULT`` of all cells, where rows of one id may repeat a pair; ``linked``: ``LINKED``, what a cell has of each id in place of its pairs."""
    result = LINKED if linked else RESULT
    kept = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"  # as exact as they came
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("e")).where("i IS NOT NULL AND e IS NOT NULL AND size(e) > 0")
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("e", lambda v: v != 0))
    lengths = rows.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], result)
    size, count = max(((r.d, r.n) for r in lengths), key=lambda x: (x[1], x[0]))
    rows = rows.where(F.size("e") == size)
    lead = min(lead, size)
    steps = sorted({*range(lead, size, max(lead, size // 4)), size})
    axes = _rotation(rows, size)
    tiles = max(1, -(-count // tile))
    # every tile may go to every group, so what is shuffled grows with their number: small groups are joined until there are few, or they are full
    group_tiles = max(group_tiles, min(-(-tiles // GROUPS), GROUP_BYTES // (12 * size * tile)))
    groups = max(1, -(-tiles // group_tiles))

    @tidy
    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("e"), size)
            y = x / np.linalg.norm(x, axis=1, keepdims=True) @ axes
            keys = [pa.array(y[:, k] if k < size else np.zeros(len(y))) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), *keys, pa.array([r.tobytes() for r in x.astype(kept)], pa.binary()), pa.array([r.tobytes() for r in y.astype("<f4")], pa.binary())], ["i", "c0", "c1", "x", "y"])

    turned = rows.mapInArrow(rotate, "i long, c0 double, c1 double, x binary, y binary")
    # groups by range of the first coordinate, in them tiles by the second
    ranged = turned.repartitionByRange(groups, "c0", "i").sortWithinPartitions("c1", "i").withColumn("g", F.spark_partition_id())

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"i": [], "x": [], "y": []}
        number, group = 0, None

        def row() -> pa.RecordBatch:
            ids = np.array(held["i"], "<i8")
            lo, hi, rest = _bounds(np.frombuffer(b"".join(held["y"]), "<f4").reshape(-1, size).astype(np.float64), lead)
            values = [[group], [number], [ids.tobytes()], [b"".join(held["x"])], [b"".join(held["y"])], [lo], [hi], [rest]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["g", "tile", "ids", "x", "y", "lo", "hi", "rest"])

        for batch in batches:
            group = batch.column("g")[0].as_py() if batch.num_rows else group
            for c in held:
                held[c] += batch.column(c).to_pylist()
            while len(held["i"]) >= tile:
                rest = {c: v[tile:] for c, v in held.items()}
                held = {c: v[:tile] for c, v in held.items()}
                yield row()
                held, number = rest, number + 1
        if held["i"]:
            yield row()

    packed = cut(ranged.select("i", "x", "y", "g").mapInArrow(pack, "g int, tile int, ids binary, x binary, y binary, lo array<double>, hi array<double>, rest double"))
    ends = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(lead)]).alias(c)
    bounds = small(cut(packed.groupBy("g").agg(ends(F.min, "lo"), ends(F.max, "hi"), F.max("rest").alias("rest"))))
    goal = threshold - SLACK
    cells = bounds.alias("a").crossJoin(bounds.alias("b")).where(F.expr(f"{_reach_sql(lead, 'a', 'b')} >= {goal}"))
    # each side of a cell has the other's bounds, and each tile goes where it may match
    sides = cells.select(F.col("a.g").alias("g"), (F.least("a.g", "b.g").cast("long") * groups + F.greatest("a.g", "b.g")).alias("cell"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), F.col("b.rest").alias("rest"))
    tiles_ = packed.alias("p").join(small(cut(sides)).alias("o"), F.expr("p.g = o.g"))
    celled = tiles_.where(F.expr(f"{_reach_sql(lead, 'p', 'o')} >= {goal}")).select("o.cell", "p.g", "p.tile", "p.ids", "p.x", "p.y")

    def compare(tiles: list[tuple], cell: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        low, high = divmod(cell, groups)
        group = np.array([t[0] for t in tiles])
        bounds = [np.stack([t[5][k] for t in tiles]) for k in range(3)]
        for p, (ga, _, ida, xa, ya, ba) in enumerate(tiles):
            near = reach(ba, bounds) >= threshold - SLACK
            if low != high:
                near &= group != ga
            blocks, most = [[p]] if near[p] else [], max(1, PRODUCTS // len(ya) // tile)
            others = np.flatnonzero(near[p + 1 :]) + p + 1
            blocks += [others[k : k + most] for k in range(0, len(others), most)]
            for block in blocks:
                idb, xb, yb = (tiles[block[0]][k] if len(block) == 1 else np.concatenate([tiles[q][k] for q in block]) for k in (2, 3, 4))
                i, j = tile_pairs(ya, yb, threshold, steps)
                u, v = xa[i], xb[j]
                cosine = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
                keep = (cosine >= threshold) & (ida[i] != idb[j])
                if block[0] == p:
                    keep &= i < j
                if keep.any():
                    yield np.minimum(ida[i], idb[j])[keep], np.maximum(ida[i], idb[j])[keep], cosine[keep]

    def links(tiles: list[tuple], cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.unique(np.concatenate([t[2] for t in tiles]))
        count, first = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a, b, _ in compare(tiles, cell):
            a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
            count += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            join(first, a, b)
        some = count > 0
        return ids[some], count[some], ids[first][some]

    @tidy
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def emit() -> pa.RecordBatch:
            none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            columns = links(held, now) if linked else [np.concatenate(c) for c in zip(none, *compare(held, now))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            for cell, g, t, ids, x, y in zip(*(batch.column(c).to_pylist() for c in ("cell", "g", "tile", "ids", "x", "y"))):
                if cell != now and held:
                    yield emit()
                    held = []
                now = cell
                turned = np.frombuffer(y, "<f4").reshape(-1, size)
                held.append((g, t, np.frombuffer(ids, "<i8"), np.frombuffer(x, kept).astype(np.float64).reshape(-1, size), turned, _bounds(turned.astype(np.float64), lead)))
        if held:
            yield emit()

    names = [c.split()[0] for c in result.split(", ")]
    return celled.repartition("cell").sortWithinPartitions("cell", "g", "tile").mapInArrow(cells, result)


def similar_pairs(vectors: DataFrame, threshold: float = 0.95, *sizes: int, **options) -> DataFrame:
    """``RESULT``: all pairs of ids with a cosine of at least ``threshold``; the others are :func:`_compared`'s parameters."""
    return _compared(vectors, False, threshold, *sizes, **options).groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))


def similar_classes(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", **options) -> DataFrame:
    """``CLASSES``: each id, the smallest id of its connected component of pairs at ``threshold``, and the number of other ids it makes a pair with.

    A cell tells of each vector its number of links and the first that they
    lead to in the cell, so that pairs are counted and never listed; they are
    only where an id has several rows, which must count once.
    """
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.count(F.lit(1)).alias("rows"))
    if ids.where("rows > 1").isEmpty():
        met = cut(_compared(vectors, True, threshold, id_col=id_col, **options))
        counts, edges = met.groupBy("vec_id").agg(F.sum("links").alias("links")), met.select("vec_id", "first")
    else:
        pairs = cut(similar_pairs(vectors, threshold, id_col=id_col, **options))
        edges = pairs.select(F.col("vec_b").alias("vec_id"), F.col("vec_a").alias("first"))
        counts = edges.union(edges.select("first", "vec_id")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("links"))
    one = F.lit(1)
    edges = cut(edges.where("vec_id <> first").select(F.col("vec_id").alias("q"), one.alias("nq"), F.col("first").alias("x"), one.alias("nx")).distinct())
    roots = components(edges).select(F.col("u").alias("vec_id"), F.col("root").alias("class_id"))
    out = ids.join(counts, "vec_id", "left").join(roots, "vec_id", "left")
    return out.select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
