"""The sample files at other sizes than the driver's, and what their queries' plans hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandloom.plans import queries as own
from strandloom.plans import sample_files
from strandloom.sinks import rdf

from .compare import connect, same

#: Queries on tables without the records' cells, and those on tables with them.
WITHOUT_TEXT = [
    "vcf_file_metadata",
    "vcf_header_lines",
    "map_file",
    "map_header",
    "map_header_line",
    "map_line",
    "batch_layout",
]
WITH_TEXT = [
    "vcf_records",
    "map_record",
    "map_call",
    "map_file_record",
    "aggregate_layout",
    "dictionary_round_trip",
    "graph_triple_counts",
    "vcf_strict_calls",
    "vcf_sample_calls",
]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def plans(spark, sf, name, monkeypatch):
    """The plan of a query's result, or of the lines that it writes."""
    written = []
    write = rdf.write_lines
    monkeypatch.setattr(rdf, "write_lines", lambda lines, *a, **k: (written.append(plan_of(lines)), write(lines, *a, **k))[1])
    result = plan_of(own.queries()[name](spark, sf))
    return written or [result]


@pytest.mark.parametrize("name", [*WITHOUT_TEXT, *WITH_TEXT])
def test_lines_come_from_narrow_rows(spark, sf, name, monkeypatch):
    """No plan gathers the records of a file, or goes through the cells of a line one by one for its fixed fields."""
    for plan in plans(spark, sf, name, monkeypatch):
        assert "flatten(" not in plan and "collect_list(struct(c_custkey" not in plan and "lambdafunction(regexp_replace" not in plan


def test_no_row_holds_a_whole_file(spark, sf):
    lines = sample_files.lines(spark, sf)
    assert "Aggregate" not in plan_of(lines) and "Scan parquet" in lines._jdf.queryExecution().executedPlan().toString()
    assert lines.groupBy("block").agg(F.max(F.length("value"))).count() == 2


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """Nations with 0 to 11 suppliers, and customers of all residues."""
    folder = str(tmp_path_factory.mktemp("uneven"))
    for name, sql in {
        "region": "SELECT 0 AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT CAST(i AS INT) AS n_nationkey, 'N' || i AS n_name, 0 AS n_regionkey FROM range(12) t(i)",
        "supplier": "SELECT row_number() OVER () AS s_suppkey, CAST(i AS INT) AS s_nationkey FROM range(12) t(i), range(11) u(j) WHERE j < i",
        "customer": "SELECT i AS c_custkey, CAST(i * 5 // 7 % 12 AS INT) AS c_nationkey, ['A', 'B'][i % 2 + 1] AS c_mktsegment FROM range(1500) t(i)",
    }.items():
        duckdb.connect().execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["vcf_records", "vcf_sample_format_values", "vcf_strict_calls"])
def test_files_of_any_width_equal_their_sql(spark, uneven, name):
    assert same(own.queries()[name](spark, uneven), connect(uneven), own.oracle_sql()[name]) >= 1500


def test_samples_are_exploded_by_number(spark, sf):
    """No function runs over a record's samples one by one, and no record is read for its file's names."""
    tables = own._tables(spark, sf)
    for name in ("sample_calls", "sample_format_values"):
        plan = plan_of(tables[name])
        assert "lambdafunction(named_struct" not in plan and "explode(sequence(1" in plan
    counted = plan_of(tables["sample_format_values"].agg(F.count(F.lit(1))))
    assert "split(SAMPLE_PAYLOAD" not in counted
