"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

A source's weight is its token share to the power ``alpha``, normalised; 1
leaves the shares, 0 makes them equal.  Two bisections find ``alpha``: the
largest at which the weights' entropy is ``target_entropy`` of its maximum, and
the least at which no source is repeated more than ``max_repeats`` times; the
larger of the two holds, so the limit wins over the entropy.  It wins over the
budget, too: one of more than ``max_repeats`` times all tokens is cut to that,
as no weights could spend it.  Tokens are counted over all documents (runs of
non-blanks).

A budget of tokens (``budget_ratio`` of all) is shared out by weight.  Each
source's documents are hashed into blocks of about ``block_tokens``; an epoch is
a permutation of its blocks.  The budget buys whole epochs and then blocks of
one more permutation while they fit; in the block where it ends, documents in
hash order while they fit.  A block's place in the mixture is the share of its
source's budget spent before it, so every stretch has the sources in proportion.

Cases: a null source is a source of its own.  Null and empty texts have no
tokens; they go with their block, in the last epoch only while budget is left.
Sources without tokens get one epoch.  Repeated rows are rows of their own
(same block, same place); where the budget ends among them, none is taken.  A single source keeps all its documents if the
budget ratio is 1.  An empty table gives an empty result.  Only id, text and
source are read for decisions; other columns are kept as they are by
:func:`remix`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .plan import cut

#: Tokens of a partition of the mixture at most, about 200 MB of text.
PARTITION_TOKENS = 1 << 25


def tempered(totals: dict[str, int], alpha: float) -> dict[str, float]:
    """Weights of the sources with tokens: shares to the power ``alpha``, normalised."""
    whole = sum(totals.values())
    raised = {s: (t / whole) ** alpha for s, t in totals.items() if t > 0}
    norm = sum(raised.values())
    return {s: x / norm for s, x in raised.items()}


def _entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def find_alpha(totals: dict[str, int], target_entropy: float, max_repeats: float, budget_ratio: float, rounds: int = 60) -> float:
    """The exponent in [0, 1]; entropy falls with it, and so do repetitions."""
    totals = {s: t for s, t in totals.items() if t > 0}
    if len(totals) < 2:
        return 1.0
    budget, goal = budget_ratio * sum(totals.values()), target_entropy * math.log(len(totals))

    def repeats(alpha: float) -> float:
        return max(w * budget / totals[s] for s, w in tempered(totals, alpha).items())

    def bisect(first_fits) -> float:
        low, high = 0.0, 1.0
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (low, middle) if first_fits(middle) else (middle, high)
        return high

    by_entropy = 1.0 if _entropy(tempered(totals, 1.0)) >= goal else bisect(lambda a: _entropy(tempered(totals, a)) < goal)
    by_repeats = 0.0 if repeats(0.0) <= max_repeats else bisect(lambda a: repeats(a) <= max_repeats)
    return max(by_entropy, by_repeats)


def _source_key(source: F.Column) -> F.Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def tokens_of(text: F.Column) -> F.Column:
    """The number of runs of non-blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows; else joined by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def _plan(keyed: DataFrame, target_entropy: float, max_repeats: float, budget_ratio: float, block_tokens: int, seed: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame, float]:
    """(s, blocks) of the sources, and (s, block, epoch, place, left): which blocks are taken; ``left`` is the rest of the budget where it ends within the block; and the tokens of the budget.

    ``keyed`` has s, z (document hash) and n (tokens).
    """
    spark = keyed.sparkSession
    totals = {r.s: r.n for r in keyed.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    budget_ratio = min(budget_ratio, max_repeats)
    alpha = find_alpha(totals, target_entropy, max_repeats, budget_ratio)
    weights, budget = tempered(totals, alpha), budget_ratio * sum(totals.values())
    rows = []
    for s, t in totals.items():
        share = round(weights[s] * budget, 3) if t else 0.0  # a limit that is met to rounding is met
        whole = int(share // t) if t else 1
        rows.append((s, int(t), whole, int(share - whole * t) if t else 0, max(1, -(-int(t) // block_tokens))))
    sources = spark.createDataFrame(rows, "s string, total long, whole int, rest long, blocks long")
    sources = _small(sources, broadcast_rows)
    per_block = keyed.join(sources, "s").withColumn("block", F.pmod("z", F.col("blocks"))).groupBy("s", "block").agg(F.sum("n").alias("n")).join(sources, "s")
    each = per_block.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    order = W.partitionBy("s", "epoch").orderBy(F.xxhash64(F.lit(seed), "s", "epoch", "block"), "block").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    taken = each.where((F.col("epoch") < F.col("whole")) | (F.col("before") < F.col("rest")))
    place = (F.col("epoch") * F.col("total") + F.col("before")) / F.greatest(F.col("whole") * F.col("total") + F.col("rest"), F.lit(1))
    left = F.when((F.col("epoch") == F.col("whole")) & (F.col("before") + F.col("n") > F.col("rest")), F.col("rest") - F.col("before"))
    return sources.select("s", "blocks"), taken.select("s", "block", "epoch", place.cast("double").alias("place"), left.alias("left")), budget


def mixed(docs: DataFrame, target_entropy: float = 0.9, max_repeats: float = 4.0, budget_ratio: float = 1.0, block_tokens: int = 1 << 18, seed: int = 17, broadcast_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, float]:
    """All columns of ``docs`` as a struct ``row``, with (s, z, block, epoch, place): one row for each copy in the mixture; and its tokens.

    Texts are counted once, into a slim table that is kept; the documents then
    meet the plan by (source, block) where they lie, the plan being broadcast
    while it has at most ``broadcast_rows`` rows and shuffled with them beyond.
    """
    text = F.col(text_col)
    keyed = docs.select(F.struct("*").alias("row"), _source_key(F.col(source_col)).alias("s"), F.xxhash64(F.col(id_col).cast("long"), text).alias("z"))
    counted = cut(docs.select(_source_key(F.col(source_col)).alias("s"), F.xxhash64(F.col(id_col).cast("long"), text).alias("z"), tokens_of(text).alias("n")))
    sources, plan, budget = _plan(counted, target_entropy, max_repeats, budget_ratio, block_tokens, seed, broadcast_rows)
    plan = cut(plan)
    placed = keyed.join(sources, "s").withColumn("block", F.pmod("z", F.col("blocks"))).drop("blocks")
    inside = placed.join(_small(plan.where("left IS NULL").drop("left"), broadcast_rows), ["s", "block"])
    # one block for each source: documents while the rest of the budget lasts
    ends = placed.join(_small(plan.where("left IS NOT NULL"), broadcast_rows), ["s", "block"]).withColumn("n", tokens_of(F.col("row")[text_col]))
    reached = F.sum("n").over(W.partitionBy("s", "block", "epoch").orderBy("z").rangeBetween(W.unboundedPreceding, W.currentRow))
    ends = ends.withColumn("reached", reached).where("reached <= left").drop("reached", "left", "n")
    return inside.unionByName(ends), budget


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, epoch, block, place): every copy of every document in the mixture, by place."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    slim = mixed(docs, **options)[0]
    return slim.select(F.col("row")[id_col].alias("doc_id"), F.col("row")[source_col].alias("source"), "epoch", "block", "place")


def remix(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of ``docs``, in order of place: each partition is a stretch of it."""
    rows, tokens = mixed(docs, **options)
    # places are spread evenly over [0, 1), so equal stretches of it are equal shares of the tokens
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens / PARTITION_TOKENS))
    stretch = F.floor(F.col("place") * parts).cast("int")
    return rows.repartitionById(parts, stretch).sortWithinPartitions("place", "z").select("row.*")
