"""Per-sample tables exploded from records.

``compat`` follows the observable tables: sample names are the words of the
collapsed column name, payloads the words of the collapsed cells (an empty cell
shifts the ones after it), and a file without samples has one named SAMPLES.
``strict`` is positional: a cell belongs to the column that it stands in.

Names become IRI parts once a file, not once a record, and only what a record
has beyond the declared names is named there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import uri_id, words
from .shared import broadcast_if_small, checkpointed


def _strings() -> F.Column:
    return F.array().cast("array<string>")


def declared(records: DataFrame, strict: bool) -> DataFrame:
    """(file, names, uris): declared sample names with their IRI parts, one row for each file that declares any."""
    names = F.col("SAMPLE_NAMES") if strict else words(F.col("SAMPLE_COLUMN"))
    each = records.select("file", "SAMPLE_COLUMN", "SAMPLE_NAMES").distinct().select("file", F.posexplode(names).alias("k", "name"))
    if strict:
        each = each.withColumn("name", F.when(F.btrim("name") == "", F.concat(F.lit("SAMPLE_"), (F.col("k") + 1).cast("string"))).otherwise(F.col("name")))
    based = each.withColumn("base", uri_id(F.col("name"), F.col("k") + 1))
    same = F.row_number().over(W.partitionBy("file", "base").orderBy("k"))
    parts = based.withColumn("uri", F.when(same > 1, F.concat("base", F.lit("_"), same.cast("string"))).otherwise(F.col("base")))
    if strict:
        # a numbered name may be another's own: such ones take their column's number, too
        taken = F.count(F.lit(1)).over(W.partitionBy("file", "uri"))
        parts = parts.withColumn("uri", F.when((taken > 1) & (F.col("uri") != F.col("base")), F.concat("uri", F.lit("_c"), (F.col("k") + 1).cast("string"))).otherwise(F.col("uri")))
    row = F.sort_array(F.collect_list(F.struct("k", "name", "uri", "base")))
    return parts.groupBy("file").agg(row.alias("d")).select("file", F.col("d.name").alias("names"), F.col("d.uri").alias("uris"), F.col("d.base").alias("bases"))


def sample_calls(records: DataFrame, strict: bool = False, headers: DataFrame | None = None) -> DataFrame:
    """SOURCE_FILE, ROW_ID, SAMPLE_INDEX, SAMPLE_ID, SAMPLE_URI_ID, SAMPLE_PAYLOAD (and FORMAT): one row for each sample of a record.

    ``headers`` (file, SAMPLE_COLUMN, SAMPLE_NAMES): the names of each file, where they are known without its records.
    """
    payloads = F.col("SAMPLE_CELLS" if strict else "SAMPLE_WORDS")
    names = broadcast_if_small(checkpointed(declared(records if headers is None else headers, strict)))  # a row for each file
    rows = records.join(names, "file", "left").withColumn("p", payloads)
    for c in ("names", "uris", "bases"):
        rows = rows.withColumn(c, F.coalesce(c, _strings()))
    n, i = F.greatest(F.size("names"), F.size("p")), F.col("i")
    # only numbers are exploded: names are picked by them from the file's, without a copy for each record
    each = rows.where(n > 0).select("SOURCE_FILE", "ROW_ID", "FORMAT", "names", "uris", "bases", "p", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    extra = F.concat(F.lit("SAMPLE_"), i.cast("string"))
    before = F.size("bases") - F.size(F.array_remove("bases", extra))
    named = F.when(before > 0, F.concat(extra, F.lit("_"), (before + 1).cast("string"))).otherwise(extra)
    return each.select(
        "SOURCE_FILE", "ROW_ID", i.cast("long").alias("SAMPLE_INDEX"), F.coalesce(F.get("names", i - 1), extra).alias("SAMPLE_ID"),
        F.coalesce(F.get("uris", i - 1), named).alias("SAMPLE_URI_ID"), F.coalesce(F.get("p", i - 1), F.lit("")).alias("SAMPLE_PAYLOAD"), "FORMAT",
    )


def tokens(c: F.Column) -> F.Column:
    """Colon-separated tokens; an empty string has none."""
    return F.when(c == "", _strings()).otherwise(F.split(c, ":"))


def zip_outer(keys: F.Column, values: F.Column) -> F.Column:
    """Positional pairs of two arrays as long as the longer one: a missing or blank key is FIELD_n, a missing value is empty."""
    n = F.greatest(F.size(keys), F.size(values))

    def one(i: F.Column) -> F.Column:
        key = F.coalesce(F.nullif(F.get(keys, i - 1), F.lit("")), F.concat(F.lit("FIELD_"), i.cast("string")))
        return F.struct(i.cast("long").alias("FORMAT_INDEX"), key.alias("FORMAT_KEY"), F.coalesce(F.get(values, i - 1), F.lit("")).alias("FORMAT_VALUE"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one))


def _token_count(c: F.Column) -> F.Column:
    """The size of :func:`tokens`, without making them."""
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) - F.length(F.replace(c, F.lit(":"))) + 1)


def format_values(calls: DataFrame) -> DataFrame:
    """One row for each FORMAT key or payload field of a sample, as :func:`zip_outer` pairs them."""
    own, i = ("SOURCE_FILE", "ROW_ID", "SAMPLE_INDEX", "SAMPLE_ID", "SAMPLE_URI_ID"), F.col("i")
    n = F.greatest(_token_count(F.col("FORMAT")), _token_count(F.col("SAMPLE_PAYLOAD")))
    pairs = calls.select(*own, tokens(F.col("FORMAT")).alias("k"), tokens(F.col("SAMPLE_PAYLOAD")).alias("v"), n.alias("n"))
    each = pairs.where("n > 0").select(*own, "k", "v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    key = F.coalesce(F.nullif(F.get("k", i - 1), F.lit("")), F.concat(F.lit("FIELD_"), i.cast("string")))
    return each.select(*own, i.cast("long").alias("FORMAT_INDEX"), key.alias("FORMAT_KEY"), F.coalesce(F.get("v", i - 1), F.lit("")).alias("FORMAT_VALUE"))
