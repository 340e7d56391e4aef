"""A corpus pipeline over ``documents``: language ID, near-deduplication, decontamination, mixing, token output.

Each stage applies one training-data operator to all that the stage before it
kept; what it returns is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import containment_dedup, language_mix, spaced_seeds, temperature_mix, token_frames
from strandloom.llm.plan import here, shared_dir, table
from strandloom.sinks import files


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of which the languages of the labels explain at least half of the words."""
    here(spark)
    return language_mix.keep_identified(docs, language_mix.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    here(spark)
    return containment_dedup.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that no benchmark item overlaps."""
    return spaced_seeds.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give the sources their tempered weights, leaving out or repeating documents, in the order of the mixture."""
    here(spark)
    return temperature_mix.remix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in shards of independent frames."""
    here(spark)
    return token_frames.write_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("temperature_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Language inference, tempered mixing and binary shards are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again by the next.

    What a stage has written is deleted once the next one is done with it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.delete(spark, before)
        before = path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
