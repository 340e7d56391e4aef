"""Triples as rows and as N-Triples lines: null typing, rendering, counting, dictionary encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.mapping import VOCABULARY
from .shared import checkpointed

#: What earlier line counters take for a triple.
LINE = r"^\s*[^#].*\.\s*$"


def type_nulls(triples: DataFrame, vocabulary: str = VOCABULARY, strict: bool = False) -> DataFrame:
    """Give the plain literal ``.`` the datatype Null; with ``strict`` also where another datatype was asked for."""
    missing = (F.col("o_kind") == "literal") & (F.col("o") == ".") & F.col("o_language").isNull()
    if not strict:
        missing &= F.col("o_datatype").isNull()
    return triples.withColumn("o_datatype", F.when(missing, F.lit(vocabulary + "Null")).otherwise(F.col("o_datatype")))


def escape(c: Column) -> Column:
    """A literal's text with the four characters escaped that N-Triples can't have."""
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return F.coalesce(c, F.lit(""))


#: What an IRI can't have between its angle brackets.
_FORBIDDEN = '[\\x00-\\x20<>"{}|^`\\\\]'


def valid_iri(c: Column) -> Column:
    """The IRI with the characters that N-Triples forbids in one percent-encoded; most have none and stay as they are."""
    one = lambda x: F.when(x.rlike(_FORBIDDEN), F.concat(F.lit("%"), F.lpad(F.hex(F.encode(x, "UTF-8")), 2, "0"))).otherwise(x)
    return F.when(c.rlike(_FORBIDDEN), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _node(value: Column, kind: Column) -> Column:
    value = F.when(kind == "blank", value).otherwise(valid_iri(value))
    return F.when(kind == "blank", F.concat(F.lit("_:"), F.regexp_replace(value, "[^A-Za-z0-9]", "_"))).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def literal() -> Column:
    """The object as an N-Triples literal."""
    quoted = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'))
    typed = F.concat(quoted, F.lit("^^<"), "o_datatype", F.lit(">"))
    return F.when(F.col("o_language").isNotNull(), F.concat(quoted, F.lit("@"), "o_language")).when(F.col("o_datatype").isNotNull(), typed).otherwise(quoted)


def nodes() -> tuple[Column, Column, Column]:
    """Subject, predicate and object as N-Triples terms."""
    o = F.when(F.col("o_kind") == "literal", literal()).otherwise(_node(F.col("o"), F.col("o_kind")))
    return _node(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), "p", F.lit(">")), o


def render(triples: DataFrame) -> DataFrame:
    """(value): one N-Triples line for each triple."""
    return triples.select(F.concat_ws(" ", *nodes(), F.lit(".")).alias("value"))


def count_lines(lines: DataFrame, pattern: str = LINE) -> DataFrame:
    """(file, triples) of N-Triples text with columns file and value, and a row TOTAL."""
    return lines.where(F.col("value").rlike(pattern)).rollup("file").agg(F.count(F.lit(1)).alias("triples")).withColumn("file", F.coalesce("file", F.lit("TOTAL")))


def distinct_parts(parts: DataFrame) -> DataFrame:
    """Parts (name, content) without those whose content an earlier name has."""
    h = F.sha2("content", 256)
    return parts.withColumn("n", F.row_number().over(W.partitionBy(h).orderBy("name"))).where("n = 1").drop("n")


def dictionary_of(terms: DataFrame) -> DataFrame:
    """(id, term) from distinct terms: dense ids from 1 in order of term.

    There is no single-task sort: terms are range-partitioned, and each
    partition's first id is the number of terms before it.
    """
    # a written copy fixes the partitions that the numbers depend on
    placed = checkpointed(terms.repartitionByRange("term").sortWithinPartitions("term").select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", (before - F.col("first") + 1).alias("shift"))
    return placed.join(starts, "part").select((F.col("at") + F.col("shift")).alias("id"), "term")


def encode_terms(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A dictionary (id, term), and the distinct triples as (s_id, p_id, o_id)."""
    s, p, o = nodes()
    rows = triples.select(s.alias("s"), p.alias("p"), o.alias("o"))
    dictionary = dictionary_of(rows.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct())
    coded = rows
    for c in ("s", "p", "o"):
        coded = coded.join(dictionary.select(F.col("term").alias(c), F.col("id").alias(f"{c}_id")), c).drop(c)
    return dictionary, coded.select("s_id", "p_id", "o_id").distinct()
