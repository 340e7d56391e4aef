"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes at most ``per_class`` labelled documents of each class (those
with the smallest id hashes), which bounds the index.

Terms are what words are made of, so that inflected and run-together forms of a
word meet: the four-byte grams of the words with a blank on either side, and the
words' beginnings of 4 to 12 bytes.  The vector space has the terms whose
presence in an example depends on its label: a chi-squared statistic of one
degree of freedom of at least ``min_chi2`` (15.1: one in ten thousand by
chance); all other terms are missing from products and norms.  Weights are
``(1 + ln tf) * ln((N + 1) / (df + 1))``, normalised, with document frequencies
counted over all documents.

The inverted index lists each term's examples in blocks of ``BLOCK`` and holds
the largest weight of each (term, block).  For a document, the sum of its
weights times these maxima bounds the cosine with any example of a block.
Blocks are scored in falling order of the bound until no unscored block's bound
reaches the ``k``-th best cosine, so the neighbours are exactly those of a full
comparison; examples are ordered so that similar ones share blocks.  Lists that
most blocks have entries of are kept as dense rows, and are used for the scored
blocks only, too.

The vote is the share of the neighbours' cosines that toxic ones hold.  Votes
become probabilities by isotonic regression of the examples' own leave-one-out
votes, weighted so that the classes have the frequencies of all labels.

Cases: a null text, or one without a term of the space, has no neighbours and
gets probability 0.  Labels with a null id or class, and labels without a
document, are left out; of several labels of one id the most toxic counts, and
of several texts the first in order.  Equal cosines are ordered by the
example's place in the index.  Repeated rows are scored each.  If only one
class has examples, no term depends on it and everything has probability 0.
Empty tables give empty results.  Texts are used whole; columns other than id
and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .plan import cut
from .textkit import SPAN_BYTES, U64, WORD, chunks, mix64, tidy

BLOCK = 64
GRAM, PREFIXES = 4, (4, 12)
RESULT = "doc_id long, probability double, vote double, toxic boolean, evidence string"


@dataclass
class Index:
    """Terms, their postings by (term, block), block maxima, and what is known of the examples.

    The longest lists (``head`` numbers their terms, -1 for others) are stored
    as rows of ``dense`` in place of postings.
    """

    vocabulary: np.ndarray
    idf: np.ndarray
    segments: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    maxima: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    head: np.ndarray
    dense: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    @property
    def blocks(self) -> int:
        return self.maxima.shape[1]


def terms(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(term hash, text number) of all occurrences, a bounded stretch of the texts at a time."""
    lowered = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(lowered) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(x) + 1 for x in lowered])
    low = 0
    while low < len(data):
        high = min(len(data), low + SPAN_BYTES)
        while WORD[data[high - 1]]:  # words stay whole; the last byte of all ends one
            high += 1
        word = np.zeros(high - low + 1 + PREFIXES[1], dtype=bool)
        word[1 : high - low + 1] = WORD[data[low:high]]
        padded = np.full(len(word), 32, dtype=U64)
        padded[1 : high - low + 1][word[1 : high - low + 1]] = data[low:high][word[1 : high - low + 1]]
        n = high - low
        inside = word[1 : n + 1] & word[2 : n + 2]
        at = np.flatnonzero(inside)
        gram = (padded[at] << U64(24)) | (padded[at + 1] << U64(16)) | (padded[at + 2] << U64(8)) | padded[at + 3]
        yield mix64(gram), np.searchsorted(ends, at + low, side="right")
        at = np.flatnonzero(word[1 : n + 1] & ~word[:n]) + 1
        value = np.zeros(len(at), dtype=U64)
        for k in range(PREFIXES[1]):
            at, value = at[word[at + k]], value[word[at + k]]
            value = value * U64(0xD6E8FEB86659FD93) + padded[at + k] + U64(1)
            if k + 1 >= PREFIXES[0]:
                yield mix64(value + U64(k)), np.searchsorted(ends, at + low - 1, side="right")
        low = high


def counts(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of the vocabulary's terms, by text and term."""
    if not len(vocabulary):
        return (np.empty(0, np.int64),) * 3
    likely = np.zeros(1 << 20, dtype=bool)
    likely[vocabulary & U64((1 << 20) - 1)] = True
    keys = [np.empty(0, np.int64)]
    for h, text in terms(texts):
        some = np.flatnonzero(likely[h & U64((1 << 20) - 1)])
        h, text = h[some], text[some]
        term = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[term] == h
        keys.append(text[known] * len(vocabulary) + term[known])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n


def weigh(size: int, text: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight) from occurrences, with each text's weights normalised."""
    w = (1 + np.log(n)) * idf[term] if len(n) else np.empty(0)
    norm = np.sqrt(np.bincount(text, w * w, minlength=size))
    keep = w > 0
    return text[keep], term[keep], (w[keep] / norm[text[keep]]).astype(np.float32)


def vectors(texts: list[str | None], vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight) of the texts."""
    return weigh(len(texts), *counts(texts, vocabulary), idf)


def build(text: np.ndarray, term: np.ndarray, w: np.ndarray, ids: np.ndarray, labels: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray) -> Index:
    """The block-max index of the examples from their weights."""
    m, v = len(ids), len(vocabulary)
    order = np.arange(m)
    if m > BLOCK and v:
        # similar examples side by side: by the signs, then the size, of their leading singular coordinates over frequent terms
        head = np.argsort(-np.bincount(term, minlength=v), kind="stable")[:256]
        place = np.full(v, -1)
        place[head] = np.arange(len(head))
        dense = np.zeros((m, len(head)), np.float32)
        inside = place[term] >= 0
        dense[text[inside], place[term[inside]]] = w[inside]
        u = np.linalg.svd(dense, full_matrices=False)[0][:, :5]
        order = np.lexsort((u[:, min(1, u.shape[1] - 1)], labels, *(u[:, k] > 0 for k in range(1, u.shape[1]))))
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    example = rank[text]
    by = np.lexsort((example, term))
    term, example, w = term[by], example[by], w[by]
    blocks = max(1, -(-m // BLOCK))
    slot = term * blocks + example // BLOCK
    maxima = np.zeros(v * blocks, np.float32)
    np.maximum.at(maxima, slot, w)
    size = np.bincount(term, minlength=v)
    often = np.flatnonzero(size >= max(BLOCK, m // 16))
    head = np.full(v, -1)
    head[often] = np.arange(len(often))
    dense = np.zeros((len(often), blocks * BLOCK), np.float32)
    inside = head[term] >= 0
    dense[head[term[inside]], example[inside]] = w[inside]
    slot, example, w = slot[~inside], example[~inside], w[~inside]
    segments = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=v * blocks)))).astype(np.int32)
    return Index(vocabulary, idf, segments, example.astype(np.int32), w, maxima.reshape(v, blocks), ids[order], labels[order], head, dense)


def _score(index: Index, q_term: np.ndarray, q_w: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Cosines of documents with all examples of a block, for pairs (doc, block): one row of BLOCK each."""
    n = size[doc]
    pair = np.repeat(np.arange(len(doc)), n)
    at = np.repeat(first[doc] - (np.cumsum(n) - n), n) + np.arange(len(pair))
    slot = q_term[at] * index.blocks + block[pair]
    start = index.segments[slot]
    length = index.segments[slot + 1] - start
    some = np.flatnonzero(length)
    pair, at, start, length = pair[some], at[some], start[some], length[some]
    posting = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    key = np.repeat(pair * BLOCK, length) + (index.examples[posting] & (BLOCK - 1))
    value = index.weights[posting] * np.repeat(q_w[at], length)
    return np.bincount(key, value, minlength=len(doc) * BLOCK).reshape(-1, BLOCK).astype(np.float32)


def nearest(index: Index, texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` examples with the highest cosine of each text (places in the index; -1 where there are fewer) and the cosines."""
    return nearest_to(index, len(texts), *vectors(texts, index.vocabulary, index.idf), k)


def nearest_to(index: Index, docs: int, text: np.ndarray, term: np.ndarray, w: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`nearest`, from weights. ``skip``: for each text a place to leave out, as its own."""
    m, b = len(index.ids), index.blocks
    scores = np.full((docs, b * BLOCK), -1.0, np.float32)
    size = np.bincount(text, minlength=docs)
    first = np.cumsum(size) - size
    some = np.flatnonzero(size)
    if len(some) and m:
        bound = np.zeros((docs, b), np.float32)
        bound[some] = np.add.reduceat(index.maxima[term] * w[:, None], first[some], axis=0)
        bound *= 1 + 1e-5  # rounding
        order = np.argsort(-bound, axis=1, kind="stable")
        row = index.head[term]
        asked = np.zeros((docs, len(index.dense)), np.float32)
        asked[text[row >= 0], row[row >= 0]] = w[row >= 0]
        tail = row < 0
        text, term, w = text[tail], term[tail], w[tail]
        size = np.bincount(text, minlength=docs)
        first = np.cumsum(size) - size
        kth = np.zeros(docs, np.float32)
        live, done, step = some, 0, max(2, -(-k // BLOCK) + 1)
        while len(live) and done < b:
            ranks = np.arange(done, min(b, done + step))
            pick = order[live][:, ranks]
            open_ = bound[live[:, None], pick] >= kth[live][:, None]
            open_ &= bound[live[:, None], pick] > 0
            live = live[open_[:, 0]]
            if not len(live):
                break
            pick, open_ = pick[: len(open_)][open_[:, 0]], open_[open_[:, 0]]
            row, col = np.nonzero(open_)
            doc, block = live[row], pick[row, col]
            found = _score(index, term, w, first, size, doc, block)
            by = np.argsort(block, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
                at = block[part[0]] * BLOCK
                found[part] += asked[doc[part]] @ index.dense[:, at : at + BLOCK]
            scores[doc[:, None], block[:, None] * BLOCK + np.arange(BLOCK)] = found
            if skip is not None:
                own = skip[live]
                scores[live[own >= 0], own[own >= 0]] = -1
            if scores.shape[1] > k:
                kth[live] = np.maximum(-np.partition(-scores[live], k - 1, axis=1)[:, k - 1], 0)
            done, step = done + step, step * 2
    scores[:, m:] = -1
    if scores.shape[1] > 4 * k:  # all that may be among the k, in their order
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        most = int((scores >= least).sum(1).max())
        near = np.argsort(~(scores >= least), axis=1, kind="stable")[:, :most] if most < scores.shape[1] // 2 else np.tile(np.arange(scores.shape[1]), (docs, 1))
        top = np.take_along_axis(near, np.argsort(-np.take_along_axis(scores, near, 1), axis=1, kind="stable")[:, :k], 1)
    else:
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    cosine = np.take_along_axis(scores, top, 1)
    return np.where(cosine > 0, top, -1), np.maximum(cosine, 0)


def votes(index: Index, top: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The toxic share of the neighbours' cosines; 0 without neighbours."""
    toxic = index.labels[np.maximum(top, 0)] if len(index.labels) else np.zeros(top.shape)
    return (cosine * toxic).sum(1) / np.maximum(cosine.sum(1), 1e-12)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray, shrink: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Rising step function of least squared error (pool adjacent violators): where steps begin, and their values."""
    xs, inverse = np.unique(x, return_inverse=True)
    weight, total = np.bincount(inverse, w), np.bincount(inverse, w * y)
    at: list[int] = []
    pool: list[list[float]] = []
    for i in range(len(xs)):
        at.append(i)
        pool.append([total[i], weight[i]])
        while len(pool) > 1 and pool[-2][0] * pool[-1][1] >= pool[-1][0] * pool[-2][1]:
            t, u = pool.pop()
            at.pop()
            pool[-1][0] += t
            pool[-1][1] += u
    # a step of few rows leans towards the mean of all
    mean, pull = (w * y).sum() / w.sum(), shrink * w.mean()
    return xs[at], np.maximum.accumulate(np.array([(t + pull * mean) / (u + pull) for t, u in pool]))


def _chosen(docs: DataFrame, known: DataFrame, per_class: int) -> DataFrame:
    """(i, y, t): the labelled texts to learn from, one for each id."""
    order = W.partitionBy("y").orderBy(F.xxhash64("i"), "i")
    chosen = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_class).select("i", "y")
    return docs.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t"))


def _vocabulary(examples: DataFrame, sizes: list[int], min_chi2: float) -> np.ndarray:
    """Hashes of the terms whose presence depends on the label; only these leave the executors."""

    @tidy
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t", 1 << 19):
            h, text = (np.concatenate(x) for x in zip(*terms(batch.column("t").to_pylist())))
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            once = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)]
            y = np.asarray(batch.column("y"))[text[once]]
            term, at = np.unique(h[once], return_inverse=True)
            n = [np.bincount(at, y == c, minlength=len(term)).astype(np.int64) for c in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n[0]), pa.array(n[1])], ["h", "n0", "n1"])

    n0, n1 = (float(x) for x in sizes)
    found = examples.select("t", "y").mapInArrow(present, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").cast("double").alias("a"), F.sum("n1").cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), n0 + n1
    spread = (a + b) * (n - a - b) * F.lit(n0 * n1)
    kept = found.where((spread > 0) & (F.pow(a * (n1 - b) - b * (n0 - a), 2) * n >= spread * min_chi2)).select("h").toPandas()
    return np.unique(kept["h"].to_numpy(dtype=np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2048, k: int = 21, min_chi2: float = 15.1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Fit the index and the calibration; ``per_class`` is the bound on labelled rows of each class. No text reaches the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg((F.max("y") > 0).cast("int").alias("y"))
    frequency = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    examples = cut(_chosen(own, known, per_class))
    rows = examples.select("i", "y").orderBy("i").collect()  # at most per_class ids of each class
    ids, y = np.array([r.i for r in rows], np.int64), np.array([r.y for r in rows], np.int64)
    sizes = np.bincount(y, minlength=2)
    vocabulary = _vocabulary(examples, sizes.tolist(), min_chi2) if sizes.all() else np.empty(0, np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @tidy
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t", 1 << 19):
            text, term, n = counts(batch.column("t").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(text)), pa.array(term), pa.array(n)], ["i", "term", "n"])

    @tidy
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = shared.value, 0
        df = np.zeros(len(words), np.int64)
        for batch in chunks(batches, "t", 1 << 19):
            df += np.bincount(counts(batch.column("t").to_pylist(), words)[1], minlength=len(words))
            rows += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], ["term", "n"])

    found = own.select("t").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    total = int(found.loc[found["term"] < 0, "n"].sum())
    found = found[found["term"] >= 0]
    df = np.zeros(len(vocabulary))
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((total + 1) / (df + 1))
    held = examples.select("i", "t").mapInArrow(occurrences, "i long, term long, n long").toPandas().sort_values(["i", "term"])
    text, term, w = weigh(len(ids), np.searchsorted(ids, held["i"].to_numpy()), held["term"].to_numpy(), held["n"].to_numpy(), idf)
    index = build(text, term, w, ids, y, vocabulary, idf)
    if not len(ids):
        return index
    place = np.empty(len(ids), np.int64)
    place[np.searchsorted(ids, index.ids)] = np.arange(len(ids))
    alone = []
    for a in range(0, len(ids), 96):
        lo, hi = np.searchsorted(text, (a, a + 96))
        size = min(96, len(ids) - a)
        alone.append(votes(index, *nearest_to(index, size, text[lo:hi] - a, term[lo:hi], w[lo:hi], k, place[a : a + size])))
    weight = np.array([frequency.get(c, 0) / max(1, sizes[c]) for c in range(2)])
    index.steps = isotonic(np.concatenate(alone), y.astype(float), weight[y])
    return index


def score(docs: DataFrame, index: Index, k: int = 21, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``RESULT`` for each row; ``evidence`` lists the neighbours, the nearest first, as ``id:cosine:class``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in chunks(batches, "t", 1 << 18):
            top, cosine = nearest(ix, batch.column("t").to_pylist(), k)
            vote = votes(ix, top, cosine)
            level = np.maximum(np.searchsorted(ix.steps[0], vote, side="right") - 1, 0)
            p = np.where(cosine.sum(1) > 0, ix.steps[1][level], 0.0)
            evidence = [",".join(f"{ix.ids[e]}:{c:.4f}:{ix.labels[e]}" for e, c in zip(es, cs) if e >= 0) for es, cs in zip(top, cosine)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(p), pa.array(vote), pa.array((p >= threshold) & (cosine.sum(1) > 0)), pa.array(evidence, pa.string())], ["doc_id", "probability", "vote", "toxic", "evidence"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, RESULT)
