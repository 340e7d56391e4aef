import pytest
from pyspark.sql import functions as F

from strandloom.functions import columns as C
from strandloom.functions import names as N
from strandloom.operators import metrics as M
from strandloom.operators import ntriples


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("1:02.5", 62.5), ("1:00:01", 3601.0), ("7.5", 7.5), ("", None), ("x:1", None), ("1:2:3:4", None), (None, None), (" 0:01 ", 1.0)])
def test_elapsed(spark, text, want):
    assert one(spark, C.elapsed_seconds, text) == want


@pytest.mark.parametrize(("text", "want"), [("3.9", 3), (" 4 ", 4), ("", None), ("bad", None), (None, None), ("-2.5", -2)])
def test_lenient_int(spark, text, want):
    assert one(spark, C.lenient_int, text) == want


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1023, "1023 B"), (1536, "1.50 KB"), (1024**3, "1.00 GB"), (3 * 1024**6, "3072.00 PB")])
def test_format_bytes(spark, n, want):
    assert one(spark, C.format_bytes, n, "long") == want


@pytest.mark.parametrize(("s", "want"), [(-1.0, "0.00s"), (1.5, "1.50s"), (123.0, "2m 3.0s"), (3723.0, "1h 2m 3.0s")])
def test_format_duration(spark, s, want):
    assert one(spark, C.format_duration, s, "double") == want


def test_strings(spark):
    assert one(spark, C.trim_cr, "a\r\r") == "a\r"
    assert one(spark, C.normalize_ws, " a\t\tb\x0b c ") == "a b c"
    assert one(spark, C.slug, " /a b/ ") == "a_b" and one(spark, C.slug, "//") == "vcf"
    assert one(spark, C.output_prefix, "a.vcf.gz") == "a" and one(spark, C.output_prefix, "a.vcf.bz") == "a.vcf.bz"
    assert one(spark, lambda c: C.uri_id(c, F.lit(3)), "é/é") == "sample_3"


def test_time_logs(spark):
    gnu = "\tUser time (seconds): 1.5\n\tSystem time (seconds): 0.25\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 0:02.00\n\tMaximum resident set size (kbytes): 77\n"
    for text, want in ((gnu, (2.0, 1.5, 0.25, 77)), ("real 3.5\nuser 2\nsys 1.0\n", (3.5, 2.0, 1.0, None)), ("", (None,) * 4)):
        assert tuple(spark.createDataFrame([(text,)], "v string").select(*C.time_log(F.col("v")).values()).first()) == want


def test_driver_names():
    assert N.compression_methods("gzip, hdt,gzip,") == ["gzip", "hdt"] and N.compression_methods("none") == N.compression_methods("") == []
    with pytest.raises(ValueError):
        N.compression_methods("zip")
    for bad in ("0", "-1", "x", ""):
        with pytest.raises(ValueError):
            N.positive_int(bad, "n")
    assert [N.compressed_format(x) for x in ("a.nt.gz", "a.br", "a.hdt", "a.hdt.br")] == ["gzip", "brotli", "hdt", "hdt_brotli"]
    assert [N.decompressed_name(x) for x in ("a.nt.gz", "a.gz", "a.hdt", "a.hdt.gz")] == ["a.nt", "a.nt", "a.nt", "a.hdt"]
    with pytest.raises(ValueError):
        N.compressed_format("a.zip")


def test_headers():
    assert [len(M.columns_for(m)) for m in ([], ["gzip"], ["brotli"], ["hdt"], ["hdt_gzip"], list(N.METHODS))] == [23, 31, 31, 32, 38, 56]


def test_upsert_and_aggregate(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "run string, name string, x string")
    new = spark.createDataFrame([("r", "b", "9")], "run string, name string, y string")
    assert sorted(map(tuple, M.upsert(old, new, ["run", "name"]).collect())) == [("r", "a", "1", None), ("r", "b", None, "9")]
    parts = spark.createDataFrame([("gzip", 0, 1.0, None, 150, 10, "x"), ("gzip", 3, 2.0, None, 90, 20, "y"), ("hdt", None, None, None, None, None, None)], "method string, exit_code int, wall_seconds double, user_seconds double, max_rss_kb long, output_size_bytes long, source string")
    got = {r.method: r for r in M.by_method(parts).collect()}
    assert (got["gzip"].exit_code, got["gzip"].wall_seconds, got["gzip"].user_seconds, got["gzip"].max_rss_kb, got["gzip"].output_size_bytes, got["gzip"].source) == (3, 3.0, None, 150, 30, "mixed")
    assert (got["hdt"].exit_code, got["hdt"].wall_seconds, got["hdt"].output_size_bytes, got["hdt"].source) == (0, None, 0, None)


def test_estimate(spark):
    assert tuple(M.estimate(spark.createDataFrame([(100, False), (50, True)], "bytes long, gzip boolean")).first()) == (150, 385, 14700, 23450)


def test_json_totals_and_triplets(spark):
    rows = [('{"artifacts":{"output_triples":{"a.nt":3,"TOTAL":3}}}',), ('{"artifacts":{"output_triples":4}}',), ("not json",)]
    assert M.total_triples(spark.createDataFrame(rows, "value string")).first().total == 7
    names = [(f"{p}.{k}.tsv",) for p, k in (("a", "records"), ("a", "header_lines"), ("a", "file_metadata"), ("b", "records"), ("b", "header_lines"))]
    complete, missing = M.triplets(spark.createDataFrame(names, "name string"))
    assert [r.prefix for r in complete.collect()] == ["a"] and [tuple(r) for r in missing.collect()] == [("b", "file_metadata")]


def test_line_count(spark):
    lines = [("f", x) for x in ("<s> <p> <o> .", "# comment.", "", "<s> <p> 'x' .  ")] + [("g", "<s> <p> <o> .")]
    assert {tuple(r) for r in ntriples.count_lines(spark.createDataFrame(lines, "file string, value string")).collect()} == {("f", 2), ("g", 1), ("TOTAL", 3)}


def test_sizes_and_durations_equal_their_sql_beyond_a_petabyte(spark, tmp_path):
    from strandloom.plans import queries as own

    from .compare import connect, same

    spark.range(0, 9_000_000, 17_989).selectExpr("id AS o_orderkey").toPandas().to_parquet(tmp_path / "orders.parquet")
    assert same(own.queries()["sizes_and_durations"](spark, str(tmp_path)), connect(str(tmp_path)), own.oracle_sql()["sizes_and_durations"]) == 501
    assert one(spark, lambda c: C.format_bytes(c, "TB"), 3 * 1024**5, "long") == "3072.00 TB" and one(spark, C.format_bytes, 3 * 1024**5, "long") == "3.00 PB"
