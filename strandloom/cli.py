"""Command line: variant files to triples, tables only, compression and decompression.

Exit codes: 0 all done, 1 something failed, 2 wrong arguments or input, 130 interrupted.
An input that fails is reported with the stage where it did, and the others go on.
"""

from __future__ import annotations

import argparse
import csv
import datetime
import json
import logging
import os
import shutil
import sys
import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .functions import names
from .operators import metrics
from .operators.ntriples import encode_terms, render, type_nulls
from .plans.compiler import compile_mapping
from .plans.mapping import VOCABULARY, MappingError, TriplesMap, default_mapping, with_sources
from .plans.tables import tables_of
from .plans.turtle import load_mapping, to_turtle
from .sinks import files, rdf
from .sinks.tables import write_tables
from .sources import tsv, vcf

log = logging.getLogger("strandloom")
MODES = ("full", "compress", "decompress", "tsv")


class StageError(Exception):
    """A failure of one input at a named stage."""

    def __init__(self, stage: str, cause: object) -> None:
        super().__init__(f"{stage}: {cause}")
        self.stage, self.cause = stage, cause


@dataclass
class Run:
    """What a run has done so far."""

    run_id: str
    out: str
    rows: list[dict] = field(default_factory=list)
    failed: list[dict] = field(default_factory=list)

    def fail(self, path: str, e: StageError) -> None:
        log.error("%s failed at %s: %s", path, e.stage, e.cause)
        self.failed.append({"run_id": self.run_id, "input": path, "stage": e.stage, "error": str(e.cause)[:500], "timestamp": now()})

    def artefact(self, name: str, content: dict) -> None:
        """What one step has measured, as it was."""
        folder = f"{self.out}/run_metrics/{self.run_id}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{names.safe_name(name)}.json", "w") as f:
            json.dump(content, f, indent=1)


def now() -> str:
    return datetime.datetime.now().isoformat(timespec="seconds")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description=__doc__.splitlines()[0])
    add = p.add_argument
    add("-m", "--mode", choices=MODES, default="full")
    add("-i", "--input", help="a variant file, or a folder of them")
    add("-q", "--rdf", "--nt", dest="rdf", help="an N-Triples file to compress")
    add("-C", "--compressed-input", help="a file to decompress")
    add("-d", "--decompress-out", help="where the decompressed file goes")
    add("-r", "--rules", help="a mapping document in place of the built-in mapping")
    add("-l", "--rdf-layout", choices=("aggregate", "batch"), default="aggregate")
    add("-P", "--partitions", help="number of output partitions (full mode)")
    add("-o", "--out", help="output folder")
    add("-T", "--tables", help="a folder of kept tables to convert, in place of variant files")
    add("--source", action="append", default=[], metavar="NAME=TABLE", help="read what a mapping calls NAME from TABLE")
    add("--print-rules", action="store_true", help="print the built-in mapping as a document to edit, and end")
    add("--dictionary", action="store_true", help="write the triples as numbers and a dictionary of terms, too")
    add("-n", "--out-name", help="base name of the output of a single input")
    add("-c", "--compression", default="gzip", help="comma-separated: " + ", ".join(names.METHODS) + "; or none")
    add("-k", "--keep-tsv", action="store_true", help="write the five tables, too")
    add("-e", "--estimate-size", action="store_true", help="tell the sizes to expect first")
    add("-R", "--keep-rdf", action="store_true", help="keep raw triples after compression")
    add("--vocabulary", default=VOCABULARY, help="namespace of classes and predicates")
    add("--strict", action="store_true", help="positional samples and typed nulls throughout")
    add("--empty-as-null", action="store_true", help="no triples for empty values")
    return p


def validate(a: argparse.Namespace) -> tuple[list[str], list[str], int | None]:
    """(inputs, methods, partitions); ValueError for anything that can't work."""
    if a.partitions is not None and a.mode != "full":
        raise ValueError("--partitions is for full mode")
    partitions = names.positive_int(a.partitions, "--partitions") if a.partitions is not None else None
    methods = names.compression_methods(a.compression)
    if not a.out:
        raise ValueError("--out is missing")
    for folder in (a.out, f"{a.out}/run_metrics", f"{a.out}/tsv"):
        if os.path.exists(folder) and not os.path.isdir(folder):
            raise ValueError(f"{folder} is a file, but a folder is needed there")
    if bad := [x for x in a.source if not all(x.partition("="))]:
        raise ValueError(f"--source needs NAME=TABLE, not {bad[0]!r}")
    if a.rules and not os.path.isfile(a.rules):
        raise ValueError(f"no such mapping: {a.rules}")
    if a.tables:
        if a.input or a.mode != "full":
            raise ValueError("--tables is for full mode, and takes the place of --input")
        inputs = [a.tables]
    elif a.mode in ("full", "tsv"):
        if not a.input:
            raise ValueError(f"{a.mode} mode needs --input")
        inputs = vcf.snapshot(a.input)
        vcf.check_names(inputs)
        if a.out_name and len(inputs) > 1:
            raise ValueError("--out-name is for a single input")
    else:
        given = a.rdf if a.mode == "compress" else a.compressed_input
        if not given or not os.path.isfile(given):
            raise ValueError(f"{a.mode} mode needs an existing file")
        if a.mode == "compress" and not given.endswith(".nt"):
            raise ValueError("an RDF input ends with .nt")
        inputs = [given]
    return inputs, methods, partitions


def mapping_of(a: argparse.Namespace) -> list[TriplesMap]:
    """The mapping document, or the built-in mapping, with its sources by the names that ``--source`` gives."""
    if not a.rules:
        return default_mapping(a.vocabulary)
    with open(a.rules, encoding="utf-8") as f:
        return with_sources(load_mapping(f.read()), dict(x.split("=", 1) for x in a.source))


def compressed(spark: SparkSession, run: Run, parts: list[str], folder: str, methods: list[str], name: str) -> tuple[dict, int]:
    """Compress the parts by every method; the columns for a metrics row, and how many files were made."""
    done, row = [], {}
    for method in methods:
        for part in parts:
            if method.startswith("hdt") and (files.size(spark, part) or 0) > rdf.HDT_WARNING_BYTES:
                log.warning("%s is large for HDT in memory", part)
            done.append(rdf.compress(spark, part, folder, method))
            run.artefact(f"{name}-{method}-{len(done)}", done[-1])
    if done:
        for r in metrics.by_method(spark.createDataFrame([{"source": None, **d} for d in done], "method string, exit_code long, wall_seconds double, output_size_bytes long, source string")).collect():
            label = metrics.METHOD_NAMES[r.method]
            row |= {f"{label}_size_bytes": r.output_size_bytes, f"exit_code_{label}": r.exit_code, f"wall_seconds_{label}": round(r.wall_seconds, 3)} | ({"hdt_source": r.source} if r.method == "hdt" else {})
        row |= {"compression_methods": "|".join(methods), "combined_rdf_size_bytes": sum(d["output_size_bytes"] for d in done)}
    return row, len(done)


def emit(spark: SparkSession, run: Run, tables: dict, prefix: str, row: dict, a: argparse.Namespace, methods: list[str], partitions: int | None) -> None:
    """The tables as triples, written and compressed; ``row`` gets what is known of it."""
    stage, began = "rdf-conversion", time.perf_counter()
    try:
        triples = type_nulls(compile_mapping(mapping_of(a), tables, a.empty_as_null), a.vocabulary, a.strict)
        target = f"{run.out}/{prefix}/{prefix}" + (".nt" if a.rdf_layout == "aggregate" else "")
        from pyspark.sql import Observation
        from pyspark.sql import functions as F

        seen = Observation()
        parts = rdf.write_lines(render(triples).observe(seen, F.count(F.lit(1)).alias("n")), target, a.rdf_layout, partitions)
        if a.dictionary:
            for name, df in zip(("terms", "triples"), encode_terms(triples)):
                df.write.mode("overwrite").parquet(f"{run.out}/{prefix}/{prefix}.dictionary/{name}")
        row |= {"output_triples": seen.get["n"], "output_path": target, "wall_seconds_java": round(time.perf_counter() - began, 3), "exit_code_java": 0, "output_dir_size_bytes": files.size(spark, f"{run.out}/{prefix}")}
        stage = "compression"
        found, made = compressed(spark, run, parts, f"{run.out}/{prefix}", methods, prefix)
        row |= found
        stage = "rdf-cleanup"
        if methods and not a.keep_rdf and made == len(methods) * len(parts):
            for part in parts:
                files.delete(spark, part)
        run.rows.append(row)
    except Exception as e:
        raise StageError(stage, e) from e


def convert(spark: SparkSession, run: Run, path: str, a: argparse.Namespace, methods: list[str], partitions: int | None) -> None:
    """One input from variants to compressed triples."""
    from pyspark.sql import functions as F

    prefix, began = a.out_name or names.prefix_of(path.rstrip("/").rpartition("/")[2]), time.perf_counter()
    row = {"run_id": run.run_id, "timestamp": now(), "output_name": prefix}
    read = None
    try:
        try:
            read = vcf.read(spark, [path])
            bad = read.lines.agg(F.count_if(~F.is_valid_utf8("value")).alias("bad"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")).first()
            # what a compressed input holds, so that sizes compare
            row["input_vcf_size_bytes"] = bad.bytes if path.endswith(".gz") else files.size(spark, path)
            if bad.bad:
                raise StageError("tsv-derivation", "bytes that aren't UTF-8")
            tables = tables_of(read, a.strict)
            if a.keep_tsv or a.mode == "tsv":
                row["tsv_output_path"] = f"{run.out}/tsv"
                row["tsv_output_size_bytes"] = write_tables(tables, row["tsv_output_path"], prefix)
            row |= {"wall_seconds_tsv": round(time.perf_counter() - began, 3), "exit_code_tsv": 0}
        except StageError:
            raise
        except Exception as e:
            raise StageError("tsv-conversion", e) from e
        if a.mode == "tsv":
            run.rows.append(row)
        else:
            emit(spark, run, tables, prefix, row, a, methods, partitions)
    finally:
        if read:
            read.close()


def append(path: str, row: dict) -> None:
    """One row more in a small CSV file with these columns."""
    new = not os.path.exists(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, fieldnames=list(row))
        if new:
            writer.writeheader()
        writer.writerow(row)


def upsert_metrics(spark: SparkSession, run: Run, merge: bool) -> None:
    """The run's rows into metrics.csv by run and output; a file with other columns is backed up first.

    With ``merge``, a row continues the newest one of its output: what it doesn't know stays.
    """
    columns, target = metrics.superset_columns(), f"{run.out}/metrics.csv"
    keep, rows = [], run.rows
    if os.path.exists(target):
        with open(target, newline="", encoding="utf-8") as f:
            header = next(csv.reader(f), [])
        if header != columns:
            shutil.copyfile(target, f"{target}.{run.run_id}.bak")
        keep = metrics.align(spark.read.option("header", True).csv(target), columns)
        if merge:
            old = {r.output_name: r.asDict() for r in keep.where(keep.output_name.isin([r["output_name"] for r in rows])).orderBy("run_id").collect()}
            rows = [old.get(r["output_name"], {}) | {k: v for k, v in r.items() if k != "run_id" or r["output_name"] not in old} for r in rows]
    text = lambda v: "" if v is None else str(v)
    new = metrics.align(spark.createDataFrame([tuple(text(r.get(c)) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns)), columns)
    found = metrics.upsert(keep, new, ["run_id", "output_name"]) if keep else new
    found.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(target + ".new")
    part = next(p for p, _ in files.listing(spark, target + ".new"))
    files.move(spark, part, target)
    files.delete(spark, target + ".new")


def report(spark: SparkSession, run: Run, mode: str, began: float) -> None:
    """What the run did: metrics.csv, its rows and failures as JSON, benchmarks of tables, and one line on the whole run."""
    folder = f"{run.out}/run_metrics"
    os.makedirs(folder, exist_ok=True)
    total = sum(r.get("output_triples", 0) for r in run.rows)
    with open(f"{folder}/{run.run_id}.json", "w") as f:
        json.dump({"run_id": run.run_id, "outputs": run.rows, "failed": run.failed, "artifacts": {"output_triples": {"TOTAL": total}}}, f, indent=1)
    if run.rows:
        upsert_metrics(spark, run, mode == "compress")
    for r in run.rows:
        if "exit_code_tsv" in r:
            append(f"{folder}/tsv_benchmark.csv", {c: r.get(c, "") for c in ("run_id", "timestamp", "output_name", "exit_code_tsv", "wall_seconds_tsv", "input_vcf_size_bytes", "tsv_output_size_bytes", "tsv_output_path")})
    took = time.perf_counter() - began
    append(f"{folder}/run_times.csv", {"run_id": run.run_id, "timestamp": now(), "mode": mode, "status": "failure" if run.failed else "success", "elapsed_seconds": f"{took:.3f}", "outputs": len(run.rows), "failed": len(run.failed), "total_triples": total})
    if run.failed:
        spark.createDataFrame(run.failed).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{run.out}/failed_inputs/{run.run_id}")


def execute(spark: SparkSession, a: argparse.Namespace, inputs: list[str], methods: list[str], partitions: int | None) -> int:
    run, began = Run(datetime.datetime.now().strftime("%Y%m%dT%H%M%S"), os.path.abspath(a.out)), time.perf_counter()
    if a.mode == "decompress":
        source = os.path.abspath(inputs[0])
        method = names.compressed_format(source)
        target = a.decompress_out or f"{run.out}/{names.decompressed_name(os.path.basename(source))}"
        os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
        rdf.decompress(spark, source, os.path.abspath(target), method)
        return 0
    if a.mode == "compress":
        source, stem = os.path.abspath(inputs[0]), os.path.basename(inputs[0]).removesuffix(".nt")
        row, _ = compressed(spark, run, [source], f"{run.out}/{stem}", methods, stem)
        run.rows.append({"run_id": run.run_id, "timestamp": now(), "output_name": stem} | row)
        report(spark, run, a.mode, began)
        return 0
    if a.tables:
        folder = os.path.abspath(inputs[0])
        for name in tsv.discover(spark, folder):
            try:
                emit(spark, run, tsv.load(spark, folder, name), name, {"run_id": run.run_id, "timestamp": now(), "output_name": name}, a, methods, partitions)
            except StageError as e:
                run.fail(f"{folder}/{name}", e)
        report(spark, run, a.mode, began)
        return 1 if run.failed else 0
    if a.estimate_size:
        sizes = spark.createDataFrame([(os.path.getsize(p), p.endswith(".gz")) for p in inputs], "bytes long, gzip boolean")
        print(metrics.estimate(sizes).first().asDict())
    for path in inputs:
        try:
            convert(spark, run, path if ":" in path.split("/")[0] else os.path.abspath(path), a, methods, partitions)
        except StageError as e:
            run.fail(path, e)
    report(spark, run, a.mode, began)
    return 1 if run.failed else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if a.print_rules:
        print(to_turtle(default_mapping(a.vocabulary)))
        return 0
    try:
        inputs, methods, partitions = validate(a)
    except ValueError as e:
        log.error("%s", e)
        return 2
    try:
        return execute(spark or SparkSession.builder.appName("strandloom").getOrCreate(), a, inputs, methods, partitions)
    except KeyboardInterrupt:
        return 130
    except (MappingError, rdf.MissingTool, OSError, ValueError) as e:
        log.error("%s", e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
