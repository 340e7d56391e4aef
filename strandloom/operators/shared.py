"""Cutting lineage into the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only on a local master, as in tests, a temporary folder takes its place;
    elsewhere a missing setting is an error, as executors don't share local
    folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet into the shared folder and read from there, so that filters and columns are pruned; and its path."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, already computed and narrow, to be broadcast while it has at most ``rows`` rows; beyond, Spark joins it as it would any table."""
    return F.broadcast(df) if df.count() <= rows else df
