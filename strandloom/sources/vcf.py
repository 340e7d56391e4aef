"""Variant Call Format files as lines with their place, and the three tables they hold.

The text is scanned once: every line is written, with its kind and its place in
its file block, into the shared folder, and all tables are made from that copy,
which is columnar, splittable (a gzip-compressed input isn't) and pruned by
kind.  Lines get their number within a file without moving: Spark's scan numbers
the rows of a partition one after another, so a line's place in its block is its
distance from the block's first row, and the blocks' sizes, a small table that
is broadcast while it is small, give the rest by a running sum.  A record's
number is its place less the lines before it that aren't records; those are the
file's head, whose length is one number, and stray comments after it, which are
rare.

The reader splits at ``\\n`` only, as a lone ``\\r`` doesn't end a line here.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import key_value, normalize_ws, trim_cr, words
from ..functions.names import is_vcf, prefix_of
from ..operators.shared import broadcast_if_small, checkpointed, written
from ..sinks import files

DEFAULT_SAMPLES = "SAMPLES"
RECORD_FIELDS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
METADATA = {"fileformat": "FILE_FORMAT", "filedate": "FILE_DATE", "source": "SOURCE_SOFTWARE", "reference": "REFERENCE_GENOME"}


def snapshot(path: str, spark: SparkSession | None = None) -> list[str]:
    """The variant files of a path, frozen now and in order of name; files that come later don't count.

    With a session, the path may be on any file system that Hadoop knows.
    """
    if spark is not None and ":" in path.split("/")[0]:
        found = [p for p, _ in files.listing(spark, path) if is_vcf(p)]
        if not found:
            raise ValueError(f"no .vcf or .vcf.gz files in {path}")
        return found
    if os.path.isfile(path):
        if not is_vcf(path):
            raise ValueError(f"not a variant file: {path}; its name needs the suffix .vcf or .vcf.gz")
        return [path]
    if not os.path.isdir(path):
        raise ValueError(f"no such input: {path}")
    found = sorted(x for x in os.listdir(path) if is_vcf(x) and os.path.isfile(os.path.join(path, x)))
    if not found:
        raise ValueError(f"no .vcf or .vcf.gz files in {path}")
    return [os.path.join(path, x) for x in found]


def check_names(paths: list[str]) -> None:
    """Refuse inputs whose outputs would take the same name, such as ``a.vcf`` and ``a.vcf.gz``."""
    seen: dict[str, str] = {}
    for path in paths:
        prefix = prefix_of(os.path.basename(path))
        if prefix in seen:
            raise ValueError(f"{seen[prefix]} and {path} share the output name {prefix!r}")
        seen[prefix] = path


@dataclass
class Variants:
    """The lines of some files, each with its number, and the tables made from them."""

    files: DataFrame
    lines: DataFrame
    records: DataFrame
    header_lines: DataFrame
    file_metadata: DataFrame
    samples: DataFrame
    path: str | None = None

    def close(self) -> None:
        """Delete the written lines; the tables can't be used any more."""
        if self.path:
            files.delete(self.lines.sparkSession, self.path)


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, SOURCE_FILE, block, at, value): every line, ``at`` rising within a block. Names are unique, so they stand for the files."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    meta = F.col("_metadata")
    name = F.url_decode(F.replace(meta["file_name"], F.lit("+"), F.lit("%2B")))  # Spark gives it as part of a URI
    return raw.select(name.alias("file"), name.alias("SOURCE_FILE"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def is_meta(value: Column) -> Column:
    return value.startswith("##")


def is_columns(value: Column) -> Column:
    return value.startswith("#CHROM\t")


def is_record(value: Column) -> Column:
    return (F.length(value) > 0) & ~value.startswith("#")


def kinds(lines: DataFrame) -> DataFrame:
    """``lines`` with ``kind``: r a record, m meta, c column names, o other."""
    value = F.col("value")
    kind = F.when(is_record(value), "r").when(is_meta(value), "m").when(is_columns(value), "c").otherwise("o")
    return lines.withColumn("kind", kind)


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``pos``, their number within the file from 1; only (file, block) counts are moved."""
    sizes = checkpointed(lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = checkpointed(sizes.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")))
    return lines.join(broadcast_if_small(starts), ["file", "block"]).withColumn("pos", F.col("at") + F.col("shift")).drop("shift", "block", "at")


def _others(placed: DataFrame) -> DataFrame:
    """By file: the length of the head without records, and the places of stray lines after it."""
    rest = placed.where("kind <> 'r'").select("file", "pos")
    gap = F.col("pos") - F.row_number().over(W.partitionBy("file").orderBy("pos"))
    marked = rest.withColumn("head", gap == 0)
    return marked.groupBy("file").agg(F.count_if("head").alias("head"), F.sort_array(F.collect_list(F.when(~F.col("head"), F.col("pos")))).alias("stray"))


def _below(places: str, pos: str) -> Column:
    """How many of a sorted array's numbers are below ``pos``, by halving; 0 where there is no array."""
    step = lambda n, b: F.when((n + b <= F.size(places)) & (F.get(places, n + b - 1) < F.col(pos)), n + b).otherwise(n)
    found = F.aggregate(F.array(*[F.lit(1 << k) for k in range(29, -1, -1)]), F.lit(0), step)
    return F.when(F.size(F.coalesce(places, F.array().cast("array<bigint>"))) == 0, F.lit(0)).otherwise(found)


def sample_columns(placed: DataFrame) -> DataFrame:
    """(file, column, names): the sample column's name and the separate names, of each file with a column line before its records."""
    # records by their place alone, so that their text isn't read for this
    column = F.min(F.when(F.col("kind") == "c", F.col("pos"))).alias("c")
    first = placed.where("kind IN ('c', 'r')").groupBy("file").agg(column, F.min(F.when(F.col("kind") == "r", F.col("pos"))).alias("r")).where("c IS NOT NULL AND (r IS NULL OR c < r)")
    line = placed.where("kind = 'c'").select("file", F.col("pos").alias("c"), F.col("value").alias("line"))
    first = first.join(line, ["file", "c"])
    cells = F.transform(F.split("line", "\t"), trim_cr)
    names = F.when(F.size(cells) >= 10, F.slice(cells, 10, F.greatest(F.size(cells) - 9, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return first.select("file", names.alias("names"), normalize_ws(F.array_join(names, " ")).alias("column"))


def header_table(placed: DataFrame) -> DataFrame:
    """SOURCE_FILE, HEADER_INDEX, HEADER_KEY, HEADER_VALUE, RAW_LINE of the ``##`` lines; the column line counts in the index."""
    value = F.col("value")
    head = placed.where("kind IN ('m', 'c')")
    index = F.row_number().over(W.partitionBy("file").orderBy("pos")).cast("long")
    raw = trim_cr(F.substr(value, F.lit(3)))
    rows = head.withColumn("HEADER_INDEX", index).where("kind = 'm'").withColumn("RAW_LINE", raw)
    key, rest = key_value(F.col("RAW_LINE"))
    return rows.select("file", "SOURCE_FILE", "HEADER_INDEX", key.alias("HEADER_KEY"), rest.alias("HEADER_VALUE"), "RAW_LINE")


def metadata_table(files: DataFrame, placed: DataFrame, headers: DataFrame) -> DataFrame:
    """One row for each file, also for an empty one; of repeated keys the last counts."""
    key, kind = F.lower("HEADER_KEY"), F.col("kind")
    last = [F.max_by("HEADER_VALUE", F.when(key == k, F.col("HEADER_INDEX"))).alias(name) for k, name in METADATA.items()]
    said = headers.groupBy("file").agg(*last)
    counts = placed.groupBy("file").agg(F.count_if(kind.isin("m", "c")).alias("h"), F.count_if(kind == "r").alias("r"))
    joined = files.join(said, "file", "left").join(counts, "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select("file", "SOURCE_FILE", *[F.coalesce(n, F.lit("")).alias(n) for n in METADATA.values()], zero(F.col("h")).alias("HEADER_COUNT"), zero(F.col("r")).alias("RECORD_COUNT"))


def _cell_words(payload: Column) -> Column:
    """:func:`words` of cells; where only tabs divide them, no pattern is matched."""
    return F.when(payload.rlike(r"[ \n\x0B\f\r]"), words(payload)).otherwise(F.array_remove(F.split(payload, "\t"), ""))


def record_table(placed: DataFrame, columns: DataFrame) -> DataFrame:
    """The records, with SAMPLES_RAW (collapsed payloads), SAMPLE_CELLS (as they are), SAMPLE_WORDS (the words of SAMPLES_RAW) and the header's sample names."""
    # a carriage return ends the cell before it, so it goes before the line is split; what follows the fixed fields stays one text
    cells = F.split(trim_cr(F.replace("value", F.lit("\r\t"), F.lit("\t"))), "\t", len(RECORD_FIELDS) + 1)
    other, columns = broadcast_if_small(checkpointed(_others(placed))), broadcast_if_small(columns)  # a row for each file
    rows = placed.where("kind = 'r'").join(other, "file", "left").join(columns, "file", "left")
    rows = rows.withColumn("cells", cells).withColumn("ROW_ID", (F.col("pos") - F.coalesce("head", F.lit(0)) - _below("stray", "pos")).cast("long"))
    fields = [F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(name) for k, name in enumerate(RECORD_FIELDS)]
    payload = F.get("cells", F.lit(len(RECORD_FIELDS)))
    return rows.select(
        "file", "SOURCE_FILE", "ROW_ID", *fields, F.coalesce(normalize_ws(payload), F.lit("")).alias("SAMPLES_RAW"), F.coalesce(F.split(payload, "\t"), F.array().cast("array<string>")).alias("SAMPLE_CELLS"),
        F.coalesce(_cell_words(payload), F.array().cast("array<string>")).alias("SAMPLE_WORDS"), *_header_columns(),
    )


def variants(sources: DataFrame, lines: DataFrame, path: str | None = None) -> Variants:
    """The tables of the files ``sources`` (file, SOURCE_FILE) from their ``lines`` (file, SOURCE_FILE, block, at, value, kind), already written."""
    placed = numbered(lines)
    columns, headers = checkpointed(sample_columns(placed)), header_table(placed)
    return Variants(sources, placed, record_table(placed, columns), headers, metadata_table(sources, placed, headers), columns, path)


def _header_columns() -> tuple[Column, Column]:
    """SAMPLE_COLUMN and SAMPLE_NAMES from a file's row of :func:`sample_columns`, or from nulls where it has none."""
    return F.coalesce(F.nullif("column", F.lit("")), F.lit(DEFAULT_SAMPLES)).alias("SAMPLE_COLUMN"), F.coalesce("names", F.array().cast("array<string>")).alias("SAMPLE_NAMES")


def sample_headers(found: Variants) -> DataFrame:
    """(file, SAMPLE_COLUMN, SAMPLE_NAMES) of every file, as its records have them."""
    return found.files.join(found.samples, "file", "left").select("file", *_header_columns())


def read(spark: SparkSession, paths: list[str]) -> Variants:
    """The tables of these files; their text is scanned here, once."""
    check_names(paths)
    lines, path = written(kinds(scan(spark, paths)), "variant-lines")
    sources = spark.createDataFrame([(os.path.basename(p), os.path.basename(p)) for p in paths], "file string, SOURCE_FILE string")
    return variants(sources, lines, path)


def invalid_text(placed: DataFrame) -> DataFrame:
    """(file, n): lines with bytes that aren't UTF-8."""
    return placed.where(~F.is_valid_utf8("value")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def declared_words(records: DataFrame) -> Column:
    """The sample names as the collapsed column name has them: a name with a blank is two."""
    return words(F.col("SAMPLE_COLUMN"))
