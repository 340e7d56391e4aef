"""Driver queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment_dedup, embedding_tiles, language_mix, line_dedup, secret_novelty, spaced_seeds, temperature_mix, token_frames, toxic_neighbours, warc_zstd
from .plan import cut, table


def op1_containment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment_dedup.duplicates(table(spark, sf_dir, "documents"))


def op2_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_novelty.scan(table(spark, sf_dir, "documents"))


def op3_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its class and its number of links: pairs grow faster than the vectors."""
    return embedding_tiles.similar_classes(table(spark, sf_dir, "embeddings"))


def embedding_tiles_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator at a threshold that vectors without near-duplicates reach, too."""
    found = embedding_tiles.similar_pairs(table(spark, sf_dir, "embeddings"), threshold=0.35, tile=64, group_tiles=2)
    return found.withColumn("cosine", F.round("cosine", 6))


EMBEDDING_ORACLE = """
WITH v AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
n AS (SELECT i, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE len(e) = (SELECT mode(len(e)) FROM v))
SELECT a.i AS vec_a, b.i AS vec_b, round(max(list_dot_product(a.e, b.e) / (a.s * b.s)), 6) AS cosine
FROM n a JOIN n b ON a.i < b.i
WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) / (a.s * b.s) >= {threshold}
GROUP BY 1, 2
"""

CLASSES_ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
n AS (SELECT i, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE len(e) = (SELECT mode(len(e)) FROM v)),
pairs AS MATERIALIZED (SELECT DISTINCT a.i AS a, b.i AS b FROM n a JOIN n b ON a.i <> b.i
  WHERE a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) / (a.s * b.s) >= {threshold}),
reached(i, r) AS (SELECT DISTINCT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT reached.i, pairs.b FROM reached JOIN pairs ON reached.r = pairs.a)
SELECT i AS vec_id, min(r) AS class_id, (SELECT count(*) FROM pairs WHERE a = i) AS links FROM reached GROUP BY i
"""


def op4_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_mix.language_mix(docs, language_mix.train(docs))


def op5_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are toxic with a probability of one half or more, all documents being scored."""
    docs = table(spark, sf_dir, "documents")
    index = toxic_neighbours.fit(docs, table(spark, sf_dir, "labels"))
    return toxic_neighbours.score(docs, index).where("toxic")


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tk")


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix.mixture(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))


def op9_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.write_shards(table(spark, sf_dir, "documents"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives with a dictionary into the shared folder and read from there."""
    pages = table(spark, sf_dir, "pages")
    archives = cut(warc_zstd.write_archives(pages, warc_zstd.train_dictionary(pages)))
    return warc_zstd.read_archives(archives).select("page_id", "target_uri", "warc_type", "content_length", "http_status", "payload", "valid")


WARC_ORACLE = """
SELECT page_id, url AS target_uri, CASE WHEN html IS NULL THEN 'metadata' ELSE 'response' END AS warc_type,
  CAST(CASE WHEN html IS NULL THEN 0 ELSE strlen(html) + 77 + strlen(CAST(strlen(html) AS VARCHAR)) END AS BIGINT) AS content_length,
  CAST(CASE WHEN html IS NULL THEN NULL ELSE 200 END AS INTEGER) AS http_status, html AS payload, true AS valid
FROM pages
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_containment_dedup, op2_secret_novelty, op3_embedding_tiles, op4_language_mix, op5_toxic_neighbours,
        op6_spaced_seeds, op7_temperature_mix, op8_line_dedup, op9_token_frames, op10_warc_zstd,
    )
    return {f.__name__: f for f in (*found, embedding_tiles_loose)}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_tiles": CLASSES_ORACLE.format(threshold=0.95), "embedding_tiles_loose": EMBEDDING_ORACLE.format(threshold=0.35), "op8_line_dedup": line_dedup.ORACLE, "op10_warc_zstd": WARC_ORACLE}
