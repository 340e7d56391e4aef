"""Edge cases of variant files; expected tables follow from the format rules by hand."""

import gzip

import pytest

from strandloom.plans.tables import load
from strandloom.sources import vcf

SITES = "##fileformat=VCFv4.2\n##source=one\n##nokey\r\n##source=two=x\n\n##reference=r\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n#stray.\n##late=1\n1\t5\t.\tA\tC\t.\tPASS\tX\r\n#other\n2\t6\t.\tG\tT\n"
MANY = '##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tA\tA_2\tB C\t/\n1\t5\t"x\tA\tC\t.\tPASS\tX\tGT::DP\t0/1:1:2:3\t\t1/1\t0\t9\n1\t5\t.\tA\tC\t.\tPASS\tX\tGT\t0/1\n'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("vcf")
    for name, text in {"sites.vcf": SITES, "many.vcf": MANY, "empty.vcf": "", "bare.vcf": "1\t5\t.\tA\tC\t.\tPASS\tX\tGT\t0/1\n", "note.txt": "x"}.items():
        (d / name).write_bytes(text.encode())
    with gzip.open(d / "packed.vcf.gz", "wt") as f:
        f.write("#CHROM\tPOS\n")
    return str(d)


@pytest.fixture(scope="module")
def tables(spark, folder):
    return {s: {k: v.cache() for k, v in load(spark, folder, s).items()} for s in (False, True)}


def rows(t, file, *columns):
    return [tuple(r) for r in t.where(t.SOURCE_FILE == file).orderBy(*columns).select(*columns).collect()]


def test_metadata_has_a_row_for_every_file(tables):
    found = {r.SOURCE_FILE: r for r in tables[False]["file_metadata"].collect()}
    assert set(found) == {"sites.vcf", "many.vcf", "empty.vcf", "bare.vcf", "packed.vcf.gz"}
    assert (found["sites.vcf"].SOURCE_SOFTWARE, found["sites.vcf"].HEADER_COUNT, found["sites.vcf"].RECORD_COUNT) == ("two=x", 7, 2)
    assert (found["empty.vcf"].FILE_FORMAT, found["empty.vcf"].HEADER_COUNT, found["empty.vcf"].RECORD_COUNT) == ("", 0, 0)
    assert found["packed.vcf.gz"].HEADER_COUNT == 1


def test_header_lines(tables):
    got = rows(tables[False]["header_lines"], "sites.vcf", "HEADER_INDEX", "HEADER_KEY", "HEADER_VALUE", "RAW_LINE")
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 7]
    assert got[2] == (3, "nokey", "", "nokey") and got[3] == (4, "source", "two=x", "source=two=x")


def test_records(tables):
    got = rows(tables[False]["records"], "sites.vcf", "ROW_ID", "CHROM", "POS", "QUAL", "INFO")
    assert got == [(1, "1", "5", ".", "X"), (2, "2", "6", "", "")]
    assert [r[1] for r in rows(tables[False]["records"], "many.vcf", "ROW_ID", "ID")] == ['"x', "."]
    assert rows(tables[False]["records"], "bare.vcf", "ROW_ID", "SAMPLE_COLUMN") == [(1, "SAMPLES")]


def test_compatible_samples(tables):
    got = rows(tables[False]["sample_calls"], "many.vcf", "ROW_ID", "SAMPLE_INDEX", "SAMPLE_ID", "SAMPLE_URI_ID", "SAMPLE_PAYLOAD")
    assert got[:6] == [(1, 1, "A", "A", "0/1:1:2:3"), (1, 2, "A", "A_2", "1/1"), (1, 3, "A_2", "A_2", "0"), (1, 4, "B", "B", "9"), (1, 5, "C", "C", ""), (1, 6, "/", "sample_6", "")]
    assert rows(tables[False]["sample_calls"], "sites.vcf", "ROW_ID", "SAMPLE_ID") == [(1, "SAMPLES"), (2, "SAMPLES")]
    values = rows(tables[False]["sample_format_values"], "many.vcf", "ROW_ID", "SAMPLE_INDEX", "FORMAT_INDEX", "FORMAT_KEY", "FORMAT_VALUE")
    assert values[:4] == [(1, 1, 1, "GT", "0/1"), (1, 1, 2, "FIELD_2", "1"), (1, 1, 3, "DP", "2"), (1, 1, 4, "FIELD_4", "3")]


def test_strict_samples_are_positional(tables):
    got = rows(tables[True]["sample_calls"], "many.vcf", "ROW_ID", "SAMPLE_INDEX", "SAMPLE_ID", "SAMPLE_PAYLOAD")
    assert got[:5] == [(1, 1, "A", "0/1:1:2:3"), (1, 2, "A", ""), (1, 3, "A_2", "1/1"), (1, 4, "B C", "0"), (1, 5, "/", "9")]
    ids = [r[2] for r in rows(tables[True]["sample_calls"], "many.vcf", "ROW_ID", "SAMPLE_INDEX", "SAMPLE_URI_ID")][:5]
    assert len(set(ids)) == 5
    assert rows(tables[True]["sample_calls"], "sites.vcf", "ROW_ID") == []


def test_row_ids_over_many_splits(spark, tmp_path):
    n = 20_000
    body = "".join(f"1\t{k}\t.\tA\tC\t.\t.\t.\n" + ("#note\n" if k % 5000 == 0 else "") for k in range(1, n + 1))
    (tmp_path / "big.vcf").write_text("##a=b\n#CHROM\tPOS\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        t = load(spark, str(tmp_path))["records"]
        assert t.rdd.getNumPartitions() > 5
        assert t.where("CAST(ROW_ID AS STRING) <> POS").count() == 0 and t.count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inputs(tmp_path):
    with pytest.raises(ValueError):
        vcf.snapshot(str(tmp_path))
    for name in ("b.vcf", "a.vcf.gz", "c.VCF", "a.vcf"):
        (tmp_path / name).write_text("")
    assert [p.rpartition("/")[2] for p in vcf.snapshot(str(tmp_path))] == ["a.vcf", "a.vcf.gz", "b.vcf"]
    with pytest.raises(ValueError, match="share the output name"):
        vcf.check_names(vcf.snapshot(str(tmp_path)))


def test_invalid_text_is_found(spark, tmp_path):
    (tmp_path / "bad.vcf").write_bytes(b"1\t5\t\xff\tA\tC\n")
    assert vcf.invalid_text(vcf.read(spark, vcf.snapshot(str(tmp_path))).lines).count() == 1


def test_text_is_scanned_once_and_lines_stay_where_they_are(spark, folder):
    """The tables' plans read the written lines only, and shuffle none of them to number them."""
    read = vcf.read(spark, vcf.snapshot(folder))
    tables = load(spark, folder)
    plans = [t._jdf.queryExecution().executedPlan().toString() for t in (*tables.values(), read.lines, read.records)]
    assert not any("Scan text" in p for p in plans) and all("Scan parquet" in p for p in plans if "Scan" in p)
    for p in plans[-2:]:
        assert "Exchange hashpartitioning" not in p
    assert "PushedFilters" in plans[-1] and "EqualTo(kind,r)" in plans[-1]
    n = read.lines.count()
    assert n == read.lines.select("file", "pos").distinct().count() > 15
    read.close()


def test_tables_kept_are_read_back(spark, folder, tables, tmp_path):
    from strandloom.sinks.tables import write_tables
    from strandloom.sources import tsv

    many = {k: v.where("SOURCE_FILE IN ('many.vcf', 'sites.vcf')") for k, v in tables[False].items()}
    write_tables(many, str(tmp_path), "x")
    assert tsv.discover(spark, str(tmp_path)) == ["x"]
    back = tsv.load(spark, str(tmp_path), "x")
    for k, t in many.items():
        assert sorted(map(repr, t.collect())) == sorted(map(repr, back[k].select(t.columns).collect())), k
    # the shape that other writers give: the sample column's name is data, carriage returns end the lines
    (tmp_path / "y.records.tsv").write_bytes(b'SOURCE_FILE\tROW_ID\tCHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA B\r\ny.vcf\t1\t1\t5\t"q\tA\tC\t.\tPASS\tX\tGT:DP\t0/1:3 1/1\r\ny.vcf\t2\t1\t6\t.\tA\tC\t\t\t\t\t\r\n')
    (tmp_path / "y.header_lines.tsv").write_text("SOURCE_FILE\tHEADER_INDEX\tHEADER_KEY\tHEADER_VALUE\tRAW_LINE\n")
    with pytest.raises(ValueError, match="y.file_metadata.tsv"):
        tsv.discover(spark, str(tmp_path))
    (tmp_path / "y.file_metadata.tsv").write_text("SOURCE_FILE\tFILE_FORMAT\tFILE_DATE\tSOURCE_SOFTWARE\tREFERENCE_GENOME\tHEADER_COUNT\tRECORD_COUNT\ny.vcf\tV\t\t\t\t1\t2\n")
    assert tsv.discover(spark, str(tmp_path)) == ["x", "y"]
    own = tsv.load(spark, str(tmp_path), "y")
    assert rows(own["records"], "y.vcf", "ROW_ID", "ID", "QUAL", "SAMPLES_RAW") == [(1, '"q', ".", "0/1:3 1/1"), (2, ".", "", "")]
    assert rows(own["sample_calls"], "y.vcf", "ROW_ID", "SAMPLE_ID", "SAMPLE_PAYLOAD") == [(1, "A", "0/1:3"), (1, "B", "1/1"), (2, "A", ""), (2, "B", "")]
