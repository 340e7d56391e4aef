import csv
import gzip
import json
import os

import pytest

from strandloom.cli import main
from strandloom.streaming.arrivals import watch

VCF = "##fileformat=V\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t5\t.\tA\tC\t.\tPASS\tX\tGT\t0/1\n"
TRIPLES = 6 + 4 + 12 + 3 + 3


@pytest.fixture
def inputs(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "good.vcf").write_text(VCF)
    return d


def test_full_run(spark, inputs, tmp_path):
    (inputs / "bad.vcf").write_bytes(VCF.encode() + b"1\t5\t\xff\tA\tC\n")
    out = tmp_path / "out"
    assert main(["-i", str(inputs), "-o", str(out), "-c", "gzip", "-k"], spark) == 1
    assert not (out / "good" / "good.nt").exists()
    with gzip.open(out / "good" / "good.nt.gz", "rt") as f:
        assert len(f.readlines()) == TRIPLES
    with open(out / "metrics.csv") as f:
        rows = list(csv.DictReader(f))
    assert [(r["output_name"], r["output_triples"], r["exit_code_gzip"]) for r in rows] == [("good", str(TRIPLES), "0")]
    run = json.load(open(next((out / "run_metrics").glob("*.json"))))
    assert run["failed"][0]["stage"] == "tsv-derivation" and run["artifacts"]["output_triples"]["TOTAL"] == TRIPLES
    assert main(["-m", "decompress", "-C", str(out / "good" / "good.nt.gz"), "-o", str(out / "back")], spark) == 0
    assert len((out / "back" / "good.nt").read_text().splitlines()) == TRIPLES


def test_batch_layout_and_rules(spark, inputs, tmp_path):
    rules = tmp_path / "own.ttl"
    rules.write_text('@prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix rr: <http://www.w3.org/ns/r2rml#> . <#M> rml:logicalSource [ rml:source "records.tsv" ] ; rr:subjectMap [ rr:template "urn:r/{ROW_ID}" ; rr:class <urn:R> ] .')
    assert main(["-i", str(inputs / "good.vcf"), "-o", str(tmp_path / "o"), "-l", "batch", "-c", "none", "-r", str(rules), "-n", "own", "-P", "1"], spark) == 0
    parts = os.listdir(tmp_path / "o" / "own" / "own")
    text = "".join((tmp_path / "o" / "own" / "own" / p).read_text() for p in parts if p.endswith(".nt"))
    assert text == "<urn:r/1> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:R> .\n"


@pytest.mark.parametrize("args", [["-m", "tsv", "-P", "2", "-i", "."], ["-i", "/no/such"], ["-c", "zip", "-i", "."], ["-m", "compress", "-q", "/no.nt"], ["-m", "what"], ["-P", "0", "-i", "."], ["-T", "x", "-i", "."], ["--source", "x", "-i", "."]])
def test_refused_arguments(args, tmp_path):
    assert main([*args, "-o", str(tmp_path)]) == 2


def metrics_of(out):
    with open(out / "metrics.csv") as f:
        return list(csv.DictReader(f))


def test_compress_continues_the_row_of_its_output(spark, inputs, tmp_path):
    out = tmp_path / "out"
    assert main(["-i", str(inputs / "good.vcf"), "-o", str(out), "-c", "none"], spark) == 0
    before = metrics_of(out)[0]
    assert before["gzip_size_bytes"] == "" and before["output_triples"] == str(TRIPLES)
    assert main(["-m", "compress", "-q", str(out / "good" / "good.nt"), "-o", str(out), "-c", "gzip"], spark) == 0
    after = metrics_of(out)
    assert len(after) == 1 and int(after[0]["gzip_size_bytes"]) > 0 and after[0]["compression_methods"] == "gzip"
    assert all(after[0][k] == v for k, v in before.items() if k in ("run_id", "output_triples", "input_vcf_size_bytes", "output_path"))
    with open(out / "run_metrics" / "run_times.csv") as f:
        assert [(r["mode"], r["status"], r["total_triples"]) for r in csv.DictReader(f)] == [("full", "success", str(TRIPLES)), ("compress", "success", "0")]
    kept = [json.load(open(p)) for p in (out / "run_metrics").glob("*/*.json")]
    assert [k["method"] for k in kept] == ["gzip"] and kept[0]["exit_code"] == 0


def test_metrics_with_other_columns_are_backed_up(spark, inputs, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "metrics.csv").write_text("run_id,output_name,mine\n1,old,x\n")
    assert main(["-i", str(inputs / "good.vcf"), "-o", str(out), "-m", "tsv"], spark) == 0
    assert {r["output_name"] for r in metrics_of(out)} == {"old", "good"} and "mine" not in metrics_of(out)[0]
    assert [p.read_text().splitlines()[1] for p in out.glob("metrics.csv.*.bak")] == ["1,old,x"]
    with open(out / "run_metrics" / "tsv_benchmark.csv") as f:
        assert [(r["output_name"], r["exit_code_tsv"], int(r["tsv_output_size_bytes"]) > 0) for r in csv.DictReader(f)] == [("good", "0", True)]


def test_size_of_a_compressed_input_is_that_of_its_text(spark, tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write(VCF)
    assert main(["-i", str(tmp_path / "a.vcf.gz"), "-o", str(tmp_path / "o"), "-m", "tsv"], spark) == 0
    assert metrics_of(tmp_path / "o")[0]["input_vcf_size_bytes"] == str(len(VCF))


def test_kept_tables_are_converted(spark, inputs, tmp_path):
    assert main(["-i", str(inputs / "good.vcf"), "-o", str(tmp_path / "a"), "-m", "tsv"], spark) == 0
    assert main(["-T", str(tmp_path / "a" / "tsv"), "-o", str(tmp_path / "b"), "-c", "none", "--dictionary", "-P", "2"], spark) == 0
    assert main(["-i", str(inputs / "good.vcf"), "-o", str(tmp_path / "c"), "-c", "none"], spark) == 0
    lines = [sorted((tmp_path / x / "good" / "good.nt").read_text().splitlines()) for x in "bc"]
    assert lines[0] == lines[1] and len(lines[0]) == TRIPLES
    coded = spark.read.parquet(str(tmp_path / "b" / "good" / "good.dictionary" / "triples"))
    assert coded.count() == TRIPLES and spark.read.parquet(str(tmp_path / "b" / "good" / "good.dictionary" / "terms")).count() == coded.selectExpr("explode(array(s_id, p_id, o_id)) AS x").distinct().count()


def test_printed_rules_are_a_mapping_of_their_own(spark, inputs, tmp_path, capsys):
    assert main(["--print-rules"]) == 0
    text = capsys.readouterr().out
    (tmp_path / "own.ttl").write_text(text.replace('"records.tsv"', '"/data/in.rec"'))
    args = ["-i", str(inputs / "good.vcf"), "-c", "none", "-r", str(tmp_path / "own.ttl")]
    assert main([*args, "-o", str(tmp_path / "a")], spark) == 1  # nothing is called so
    assert main([*args, "-o", str(tmp_path / "b"), "--source", "in=records"], spark) == 0
    assert len((tmp_path / "b" / "good" / "good.nt").read_text().splitlines()) == TRIPLES


def test_stream_of_arrivals(spark, inputs, tmp_path):
    out, check = str(tmp_path / "s"), str(tmp_path / "c")
    for k in range(2):
        watch(spark, str(inputs), out, check).awaitTermination()
        assert spark.read.text(out).count() == TRIPLES * (k + 1)
        (inputs / f"later{k}.vcf").write_text(VCF)
