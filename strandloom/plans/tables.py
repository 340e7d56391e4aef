"""The five logical tables by the names that mappings refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.samples import format_values, sample_calls
from ..sources import vcf

CALL_COLUMNS = ("SOURCE_FILE", "ROW_ID", "SAMPLE_INDEX", "SAMPLE_ID", "SAMPLE_URI_ID", "SAMPLE_PAYLOAD")
RECORD_COLUMNS = ("SOURCE_FILE", "ROW_ID", *vcf.RECORD_FIELDS)


def tables_of(variants: vcf.Variants, strict: bool = False) -> dict[str, DataFrame]:
    """file_metadata, header_lines, records, sample_calls and sample_format_values."""
    calls = sample_calls(variants.records, strict, vcf.sample_headers(variants))
    return {
        "file_metadata": variants.file_metadata.drop("file"),
        "header_lines": variants.header_lines.drop("file"),
        "records": variants.records.select(*RECORD_COLUMNS, "SAMPLES_RAW", "SAMPLE_COLUMN"),
        "sample_calls": calls.select(*CALL_COLUMNS),
        "sample_format_values": format_values(calls),
    }


def load(spark: SparkSession, path: str, strict: bool = False) -> dict[str, DataFrame]:
    """The five tables of all variant files of a path."""
    return tables_of(vcf.read(spark, vcf.snapshot(path)), strict)
