"""Language identification as multilingual mixture inference.

Every language has a table of log-probabilities of byte trigrams inside padded
words, trained on a bounded sample of labelled documents.  A document is a
mixture: each of its words is drawn from one language, and
expectation-maximisation estimates the proportions from the words' n-gram
likelihoods.  A uniform background (``und``) competes with the languages, so
text that no model explains is recognised as such.  The reported language set
is the one with the highest penalised likelihood: sets are nested by estimated
share, and each further language must raise the log-likelihood by
``penalty * log(words)``.

Cases: a null, empty or letterless text has no language (``lang`` null, no
shares, ``accepted`` false).  Null ids, ties and repeated rows are passed
through row by row; equal shares are ordered by language name.  Without any
labelled row there is no model and nothing is accepted.  An empty table gives
an empty result.  Only the id, text and label columns are read, so any other
column, whatever its name, is ignored here and kept unchanged by
:func:`keep_identified`.  Texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .textkit import CHUNK_BYTES, chunks, tidy

BUCKETS = 1 << 16
UND = "und"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
RESULT = "doc_id long, lang string, languages string, share double, background double, n_words long, accepted boolean"


@dataclass(frozen=True)
class Model:
    """Trigram log-probabilities: ``table[bucket, language]``, the background last."""

    languages: tuple[str, ...]
    table: np.ndarray


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all letter bytes, where each word's begin, and words by text."""
    lowered = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(lowered) + b"\n", dtype=np.uint8)
    letter = _LETTER[data]
    padded = np.where(letter, data, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    code = (padded[at - 1] << 16) | (padded[at] << 8) | padded[at + 1]
    buckets = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    first = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(x) + 1 for x in lowered]) + 1
    offsets = np.concatenate(([0], np.searchsorted(at[first], ends)))
    return buckets, first, offsets


def train(docs: DataFrame, sample_per_language: int = 400, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit the trigram tables on at most ``sample_per_language`` labelled rows of each language.

    The sample is the rows with the smallest hash of the id, so it doesn't
    depend on partitioning.  Every label with a trigram in its sample gets a
    table.
    """
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL AND i IS NOT NULL")
    order = W.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    chosen = labelled.select("i", "l").withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_per_language).select("i", "l")
    sample = labelled.join(F.broadcast(chosen), ["i", "l"], "left_semi")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "t"):
            texts, langs = batch.column("t").to_pylist(), batch.column("l").to_pylist()
            for lang in sorted(set(langs)):
                buckets = _grams([t for t, x in zip(texts, langs) if x == lang])[0]
                totals[lang] = totals.get(lang, 0) + np.bincount(buckets, minlength=BUCKETS)
        for lang, total in totals.items():
            g = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(total[g])], ["l", "g", "n"])

    rows = sample.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    parts = dict(list(rows.groupby("l"))) if len(rows) else {}
    languages = tuple(sorted(parts))
    table = np.full((BUCKETS, len(languages) + 1), -np.log(BUCKETS), dtype=np.float32)
    for k, lang in enumerate(languages):
        c = np.full(BUCKETS, smoothing)
        c[parts[lang]["g"].to_numpy()] += parts[lang]["n"].to_numpy()
        table[:, k] = np.log(c / c.sum())
    return Model(languages, table)


def _em(p: np.ndarray, doc: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Mixture shares of each document; ``p`` are scaled word likelihoods, ``allowed`` masks components."""
    n_docs = len(first)
    share = (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
    counts = np.diff(np.concatenate((first, [len(p)]))).astype(np.float32)[:, None]
    live, words, d, at = np.arange(n_docs), p, doc, first
    for _ in range(rounds):
        r = words * share[live][d]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        new = np.add.reduceat(r, at, axis=0) / counts[live]
        moved = np.abs(new - share[live]).max(1) > tolerance
        share[live] = new
        if not moved.any():
            break
        if moved.mean() < 0.7:
            keep = moved[d]
            words, live = words[keep], live[moved]
            sizes = counts[live][:, 0].astype(np.int64)
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            d = np.repeat(np.arange(len(live)), sizes)
    return share


def _log_likelihood(p: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.log(np.maximum((p * share[doc]).sum(1), 1e-30)), first)


def infer(texts: list[str | None], model: Model, penalty: float = 3.0, rounds: int = 60, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each text by component (zero outside the selected set), and its number of words."""
    parts = len(model.languages) + 1
    shares = np.zeros((len(texts), parts))
    buckets, word_at, offsets = _grams(texts)
    n_words = np.diff(offsets)
    some = np.flatnonzero(n_words)
    if not len(some) or parts == 1:
        shares[some, -1] = 1
        return shares, n_words
    score = np.add.reduceat(model.table[buckets], word_at, axis=0)
    score -= score.max(1, keepdims=True)
    # beyond this, one word could decide a whole document
    p = np.exp(np.maximum(score, -12.0)).astype(np.float32)
    doc, first = np.repeat(np.arange(len(some)), n_words[some]), offsets[:-1][some]
    full = _em(p, doc, first, np.ones((len(some), parts)), rounds, tolerance)
    best = np.argsort(-full, axis=1, kind="stable")
    cost = penalty * np.log(n_words[some] + 1.0)
    one = np.zeros_like(full)
    # alone, the component with the highest likelihood
    alone = np.add.reduceat(np.log(p), first, axis=0)
    one[np.arange(len(some)), alone.argmax(1)] = 1
    chosen, value = one, alone.max(1) - cost
    ceiling = _log_likelihood(p, doc, first, full)
    for k in range(2, parts + 1):
        # no set of k can beat the likelihood of all components
        open_ = np.flatnonzero(ceiling - k * cost > value)
        if not len(open_):
            break
        allowed = np.zeros((len(open_), parts))
        np.put_along_axis(allowed, best[open_, :k], 1.0, axis=1)
        sizes = n_words[some][open_]
        picked = np.isin(doc, open_) if len(open_) < len(some) else slice(None)
        sub_first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        sub_doc, sub_p = np.repeat(np.arange(len(open_)), sizes), p[picked]
        found = full[open_] if k == parts else _em(sub_p, sub_doc, sub_first, allowed, rounds, tolerance)
        now = _log_likelihood(sub_p, sub_doc, sub_first, found) - k * cost[open_]
        better = now > value[open_]
        chosen[open_[better]], value[open_[better]] = found[better], now[better]
    shares[some] = chosen
    return shares, n_words


def _limit(model: Model) -> int:
    """Bytes of text to score at once, fewer when many languages widen the scores."""
    return CHUNK_BYTES * 16 // max(16, len(model.languages) + 1)


def _broadcast(spark: SparkSession, model: Model) -> Broadcast:
    return spark.sparkContext.broadcast(model)


def language_mix(docs: DataFrame, model: Model, min_share: float = 0.5, penalty: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``RESULT`` for each row of ``docs``.

    ``languages`` lists the selected set as ``lang:share`` in falling order;
    ``accepted`` says that the languages together explain at least
    ``min_share`` of the words.
    """
    shared = _broadcast(docs.sparkSession, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = [*m.languages, UND]
        for batch in chunks(batches, "t", _limit(m)):
            shares, n = infer(batch.column("t").to_pylist(), m, penalty)
            known = shares[:, :-1].sum(1)
            lang, sets = [], []
            for row, words in zip(shares, n):
                order = [k for k in np.argsort(-row, kind="stable") if row[k] > 0]
                lang.append(names[order[0]] if words else None)
                sets.append(",".join(f"{names[k]}:{row[k]:.3f}" for k in order) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), pa.array(lang, pa.string()), pa.array(sets, pa.string()), pa.array(shares.max(1)), pa.array(shares[:, -1]), pa.array(n.astype(np.int64)), pa.array((n > 0) & (known >= min_share))],
                ["doc_id", "lang", "languages", "share", "background", "n_words", "accepted"],
            )

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, model: Model, min_share: float = 0.5, penalty: float = 3.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is accepted, with all their columns; no shuffle."""
    shared = _broadcast(docs.sparkSession, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, text_col, _limit(m)):
            shares, n = infer(batch.column(text_col).to_pylist(), m, penalty)
            yield batch.filter(pa.array((n > 0) & (shares[:, :-1].sum(1) >= min_share)))

    return docs.mapInArrow(run, docs.schema)
