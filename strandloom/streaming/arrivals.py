"""A folder watched for variant files.

Each micro-batch is the set of files that arrived since the last one; a batch
is read through the same plans as a fixed input, so line numbers, headers and
sample names are those of whole files.  Offsets are checkpointed by Structured
Streaming, and a batch's output folder is named by its number and replaced if
the batch runs again, so every file's triples are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ntriples import render, type_nulls
from ..plans.compiler import compile_mapping
from ..plans.mapping import VOCABULARY, TriplesMap, default_mapping
from ..plans.tables import tables_of
from ..sources import vcf


def watch(spark: SparkSession, folder: str, output: str, checkpoint: str, maps: list[TriplesMap] | None = None, vocabulary: str = VOCABULARY, strict: bool = False, files_per_batch: int = 64) -> StreamingQuery:
    """Start a query that writes N-Triples text of newly arrived files under ``output``; it ends once all present are done."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrivals = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{vcf,vcf.gz}").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")

    def batch(rows: DataFrame, number: int) -> None:
        paths = sorted(r.path for r in rows.select(F.col("path")).collect())  # names only, at most files_per_batch
        if paths:
            read = vcf.read(spark, paths)
            triples = type_nulls(compile_mapping(maps or default_mapping(vocabulary), tables_of(read, strict)), vocabulary, strict)
            render(triples).write.mode("overwrite").text(f"{output}/batch={number}")
            read.close()

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
