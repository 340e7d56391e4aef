"""Small planning helpers: reading tables, cutting lineage, checking arguments."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import broadcast_if_small as small
from ..operators.shared import checkpointed as cut
from ..operators.shared import folder as shared_dir

__all__ = ["cut", "here", "shared_dir", "small", "table", "text_key"]


#: What a Python worker gets at once where the session doesn't say: ten thousand texts, or 64 MB, are much.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def here(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; elsewhere ship it with ``--py-files``.

    Batches to workers get smaller unless the session has limits of its own.
    """
    for name, ours in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, ours)
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "").split(":")
    if root not in known:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, known)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    here(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text) -> F.Column:
    """A 64-bit key of a text; with the document's id it names a row. A null text has a key of its own."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))
