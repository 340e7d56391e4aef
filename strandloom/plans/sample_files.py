"""Variant files made of the driver's tables, for queries that run the engine's own operators on them.

Each nation is a file: its suppliers are the samples, its customers the records.
The lines have what real files have: repeated and odd header lines, a header
line after the column line, carriage returns, comments and blank lines among
the records, short rows, empty cells, more cells than names, repeated names.
One more file is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import written
from ..sources import vcf

EMPTY = "empty.vcf"
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(file, SOURCE_FILE, block, at, value, kind) of all files but the empty one, in two blocks each.

    What is written is a narrow row for each line: its place, its kind, how it
    starts, and for records what the rest is made of.  ``value`` is put together
    where it is asked for: a record has a cell for each supplier of its nation,
    so all text together grows with the product of both tables.
    """
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    nation = read("nation").join(read("region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", "r_name")
    names = read("supplier").groupBy("s_nationkey").agg(F.expr("transform(sort_array(collect_list(s_suppkey)), k -> concat('S#', cast(k % 2 as string)))").alias("names"))
    both = nation.join(names, F.expr("s_nationkey = n_nationkey"), "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    head = both.select("n_nationkey", F.lit(0).alias("block"), F.expr(f"""posexplode(array('##fileformat=VCFv4.2', concat('##source=', n_name), '##nokey\\r', concat('##Source=', n_name, '=', n_regionkey), concat('##reference=', r_name),
        array_join(concat(array('{COLUMNS.replace(chr(9), chr(92) + "t")}'), names), '\\t'), concat('##late=', n_nationkey))) AS (at, value)"""))
    short = "concat_ws('\\t', c_mktsegment, c_custkey, if(c_custkey % 3 = 0, '.', concat('rs', c_custkey)), 'A', concat('C', c_custkey % 4))"
    extra = "concat(if(c_custkey % 11 = 0, array('#note'), array()), if(c_custkey % 13 = 0, array(''), array()))"
    size = read("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    sized = nation.join(size, F.expr("s_nationkey = n_nationkey"), "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("size"))
    rows = read("customer").join(F.broadcast(sized), F.expr("c_nationkey = n_nationkey")).select("n_nationkey", "c_custkey", "size", F.expr(f"concat(array({short}), {extra})").alias("values"))
    # a running sum over narrow rows
    before = F.coalesce(F.sum(F.size("values")).over(W.partitionBy("n_nationkey").orderBy("c_custkey").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    body = rows.withColumn("before", before).select("n_nationkey", F.lit(1).alias("block"), "before", "c_custkey", "size", F.posexplode("values").alias("k", "value"))
    # places within a block needn't begin at 0
    body = body.select("n_nationkey", "block", (F.col("before") + F.col("k") + 1000).alias("at"), "value", F.when(F.col("k") == 0, F.col("c_custkey")).alias("c"), "size")
    each = head.unionByName(body, allowMissingColumns=True)
    narrow = vcf.kinds(each.select(F.format_string("n%d.vcf", "n_nationkey").alias("file"), "block", F.col("at").cast("long").alias("at"), "value", "c", "size"))
    # the rows are few bytes and much work: as many parts as the session gives any shuffle
    kept, _ = written(narrow.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "at"), "sample-lines")
    return kept.select("file", F.col("file").alias("SOURCE_FILE"), "block", "at", F.expr(f"if(c is null, value, {_record()})").alias("value"), "kind")


def _record() -> str:
    """A record's line from its start ``value``: every seventh is short; cells repeat after five columns, of which one is empty."""
    filled = "concat('\\t0/1:', c % 50, if(c % 6 = 0, ':x', ''))"
    cell = lambda j: f"if((c + {j}) % 5 = 0, '\\t', {filled})"
    some = ", ".join(f"if(size % 5 >= {j}, {cell(j)}, '')" for j in range(1, 5))
    cells = f"repeat(concat({', '.join(map(cell, range(1, 6)))}), cast(size div 5 as int)), {some}"
    form = "case c % 4 when 0 then 'GT::DP' when 1 then '' else 'GT:DP' end"
    rest = f"concat('\\t', c % 100, '\\tPASS\\tNS=', c % 5, '\\t', {form}, {cells}, if(c % 9 = 0, '\\t1/1\\t1/2', ''))"
    return f"concat(value, if(c % 7 = 0, '', {rest}), if(c % 2 = 0, '\\r', ''))"


def variants(spark: SparkSession, d: str) -> vcf.Variants:
    files = spark.read.parquet(f"{d}/nation.parquet").select(F.format_string("n%d.vcf", "n_nationkey").alias("file")).union(spark.createDataFrame([(EMPTY,)], "file string"))
    return vcf.variants(files.select("file", F.col("file").alias("SOURCE_FILE")), lines(spark, d))


#: What the tables of these files must be, from the driver's tables by other means. Each query selects from one of the last five.
TABLES_SQL = """
WITH s AS (SELECT s_nationkey AS k, list('S#' || (s_suppkey % 2) ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1),
f AS (SELECT n_nationkey AS k, 'n' || n_nationkey || '.vcf' AS file, n_name, n_regionkey, r_name, coalesce(names, []) AS names FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN s ON s.k = n_nationkey),
c AS (SELECT f.*, c_custkey AS c, c_mktsegment AS m, c_custkey % 7 <> 0 AS long_, row_number() OVER (PARTITION BY file ORDER BY c_custkey) AS ROW_ID,
  list_concat(list_transform(range(1, len(names) + 1), lambda j: CASE WHEN (c_custkey + j) % 5 = 0 THEN '' ELSE '0/1:' || (c_custkey % 50) || CASE WHEN c_custkey % 6 = 0 THEN ':x' ELSE '' END END), CASE WHEN c_custkey % 9 = 0 THEN ['1/1', '1/2'] ELSE [] END) AS cells
  FROM customer JOIN f ON f.k = c_nationkey),
r AS (SELECT file AS SOURCE_FILE, ROW_ID, m AS CHROM, CAST(c AS VARCHAR) AS POS, CASE WHEN c % 3 = 0 THEN '.' ELSE 'rs' || c END AS ID, 'A' AS REF, 'C' || (c % 4) AS ALT,
  CASE WHEN long_ THEN CAST(c % 100 AS VARCHAR) ELSE '' END AS QUAL, CASE WHEN long_ THEN 'PASS' ELSE '' END AS FILTER, CASE WHEN long_ THEN 'NS=' || (c % 5) ELSE '' END AS INFO,
  CASE WHEN NOT long_ THEN '' WHEN c % 4 = 0 THEN 'GT::DP' WHEN c % 4 = 1 THEN '' ELSE 'GT:DP' END AS FORMAT, CASE WHEN long_ THEN list_filter(cells, lambda x: x <> '') ELSE [] END AS p, CASE WHEN len(names) > 0 THEN names ELSE ['SAMPLES'] END AS names, CASE WHEN long_ THEN cells ELSE [] END AS cells, len(names) AS declared FROM c),
records AS (SELECT SOURCE_FILE, ROW_ID, CHROM, POS, ID, REF, ALT, QUAL, FILTER, INFO, FORMAT, array_to_string(p, ' ') AS SAMPLES_RAW, array_to_string(names, ' ') AS SAMPLE_COLUMN FROM r),
header_lines AS (SELECT file AS SOURCE_FILE, CAST(h.i AS BIGINT) AS HEADER_INDEX, h.k AS HEADER_KEY, h.v AS HEADER_VALUE, h.k || CASE WHEN h.k = 'nokey' THEN '' ELSE '=' || h.v END AS RAW_LINE
  FROM (SELECT file, unnest([{'i': 1, 'k': 'fileformat', 'v': 'VCFv4.2'}, {'i': 2, 'k': 'source', 'v': n_name}, {'i': 3, 'k': 'nokey', 'v': ''}, {'i': 4, 'k': 'Source', 'v': n_name || '=' || n_regionkey}, {'i': 5, 'k': 'reference', 'v': r_name}, {'i': 7, 'k': 'late', 'v': CAST(k AS VARCHAR)}]) AS h FROM f)),
file_metadata AS (SELECT f.file AS SOURCE_FILE, 'VCFv4.2' AS FILE_FORMAT, '' AS FILE_DATE, n_name || '=' || n_regionkey AS SOURCE_SOFTWARE, r_name AS REFERENCE_GENOME, CAST(7 AS BIGINT) AS HEADER_COUNT, coalesce(n, 0) AS RECORD_COUNT FROM f LEFT JOIN (SELECT file, count(*) AS n FROM c GROUP BY 1) USING (file)
  UNION ALL SELECT 'empty.vcf', '', '', '', '', 0, 0),
calls_ AS (SELECT SOURCE_FILE, ROW_ID, FORMAT, i AS SAMPLE_INDEX, coalesce(names[i], 'SAMPLE_' || i) AS SAMPLE_ID, coalesce(p[i], '') AS SAMPLE_PAYLOAD FROM (SELECT *, unnest(range(1, greatest(len(names), len(p)) + 1)) AS i FROM r)),
calls AS (SELECT SOURCE_FILE, ROW_ID, FORMAT, SAMPLE_INDEX, SAMPLE_ID, replace(SAMPLE_ID, '#', '_') || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS SAMPLE_URI_ID, SAMPLE_PAYLOAD FROM (SELECT *, row_number() OVER (PARTITION BY SOURCE_FILE, ROW_ID, SAMPLE_ID ORDER BY SAMPLE_INDEX) AS n FROM calls_)),
sample_calls AS (SELECT SOURCE_FILE, ROW_ID, SAMPLE_INDEX, SAMPLE_ID, SAMPLE_URI_ID, SAMPLE_PAYLOAD FROM calls),
strict_calls AS (SELECT SOURCE_FILE, ROW_ID, i AS SAMPLE_INDEX, CASE WHEN i <= declared THEN names[i] ELSE 'SAMPLE_' || i END AS SAMPLE_ID, coalesce(cells[i], '') AS SAMPLE_PAYLOAD FROM (SELECT *, unnest(range(1, greatest(declared, len(cells)) + 1)) AS i FROM r)),
pairs AS (SELECT *, CASE WHEN FORMAT = '' THEN [] ELSE string_split(FORMAT, ':') END AS a, CASE WHEN SAMPLE_PAYLOAD = '' THEN [] ELSE string_split(SAMPLE_PAYLOAD, ':') END AS b FROM calls),
sample_format_values AS (SELECT SOURCE_FILE, ROW_ID, SAMPLE_INDEX, SAMPLE_ID, SAMPLE_URI_ID, i AS FORMAT_INDEX, coalesce(nullif(a[i], ''), 'FIELD_' || i) AS FORMAT_KEY, coalesce(b[i], '') AS FORMAT_VALUE FROM (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM pairs))
"""

_ROOT, _RDF, _V = "'file://' || SOURCE_FILE", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "urn:variant-triples:vocab#"
_SHAPES = {
    "file": _ROOT, "header": f"{_ROOT} || '#header'", "line": f"{_ROOT} || '#header/line/' || HEADER_INDEX", "record": f"{_ROOT} || '#record/' || ROW_ID", "call": f"{_ROOT} || '#call/' || ROW_ID",
    "sample": f"{_ROOT} || '#sample/' || ROW_ID || '/' || SAMPLE_URI_ID", "value": f"{_ROOT} || '#sample/' || ROW_ID || '/' || SAMPLE_URI_ID || '/fmt/' || FORMAT_KEY",
}
#: Of each map: its table, its subject, and (predicate, object) with a class, a shape or a column; ^ marks integers.
MAPS = {
    "file": ("file_metadata", "file", (("a", "VCFFile"), ("hasHeader", "header"), ("fileFormat", "FILE_FORMAT"), ("sourceSoftware", "SOURCE_SOFTWARE"), ("referenceGenome", "REFERENCE_GENOME"))),
    "header": ("file_metadata", "header", (("a", "VCFHeader"),)),
    "file-record": ("records", "file", (("hasRecord", "record"),)),
    "header-line": ("header_lines", "header", (("hasHeaderLine", "line"),)),
    "line": ("header_lines", "line", (("a", "HeaderLine"), ("headerKey", "HEADER_KEY"), ("headerValue", "HEADER_VALUE"))),
    "record": ("records", "record", (("a", "VCFRecord"), ("chrom", "CHROM"), ("pos", "^POS"), ("recordId", "ID"), ("ref", "REF"), ("alt", "ALT"), ("hasCall", "call"))),
    "call": ("records", "call", (("a", "VariantCall"), ("filter", "FILTER"), ("infoRaw", "INFO"), ("formatRaw", "FORMAT"))),
    "call-sample": ("sample_calls", "call", (("hasSampleCall", "sample"),)),
    "sample": ("sample_calls", "sample", (("a", "SampleCall"), ("sampleId", "SAMPLE_ID"))),
    "sample-value": ("sample_format_values", "sample", (("hasFormatValue", "value"),)),
    "value": ("sample_format_values", "value", (("a", "FormatFieldValue"), ("fieldValue", "FORMAT_VALUE"))),
}


def triples_sql(name: str) -> str:
    """The N-Triples lines of one map of the default mapping, literals without characters that need escaping."""
    table, subject, pairs = MAPS[name]
    out = []
    for p, o in pairs:
        predicate = f"<{_RDF}type>" if p == "a" else f"<{_V}{p}>"
        if p == "a":
            made = f"'<{_V}{o}>'"
        elif o in _SHAPES:
            made = f"'<' || {_SHAPES[o]} || '>'"
        else:
            integer, column = o.startswith("^"), o.lstrip("^")
            plain = f"CASE WHEN {column} = '.' THEN '\".\"^^<{_V}Null>' ELSE '\"' || {column} || '\"' END"
            made = f"'\"' || {column} || '\"^^<http://www.w3.org/2001/XMLSchema#integer>'" if integer else plain
        out.append(f"SELECT '<' || {_SHAPES[subject]} || '> {predicate} ' || {made} || ' .' AS value FROM {table}")
    return TABLES_SQL + " UNION ALL ".join(out)
