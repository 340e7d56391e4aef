"""Declarative mappings from tables to triples: the intermediate form and the default mapping."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

RR = "http://www.w3.org/ns/r2rml#"
RML = "http://semweb.mmlab.be/ns/rml#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
#: Namespace of classes and predicates unless the caller names another.
VOCABULARY = "urn:variant-triples:vocab#"


class MappingError(ValueError):
    """A mapping that can't be used; the message says which construct and where."""


@dataclass(frozen=True)
class Term:
    """How a subject, predicate or object comes about: exactly one of template, reference, constant."""

    template: str | None = None
    reference: str | None = None
    constant: str | None = None
    kind: str = "literal"  # iri, literal or blank
    datatype: str | None = None
    language: str | None = None


@dataclass(frozen=True)
class Join:
    """An object that is another map's subject, where the columns are equal."""

    parent: str
    conditions: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class TriplesMap:
    """One table, a subject, its classes, and pairs of predicate and object."""

    name: str
    source: str
    subject: Term
    classes: tuple[str, ...] = ()
    pairs: tuple[tuple[Term, Term | Join], ...] = field(default=())


def iri(value: str) -> Term:
    return Term(constant=value, kind="iri")


def default_mapping(vocabulary: str = VOCABULARY) -> list[TriplesMap]:
    """The eleven maps of the variant tables.

    Links between tables are templates on both sides, never joins, so the whole
    graph is projections.
    """
    root = "file://{SOURCE_FILE}"
    shape = {
        "file": root, "header": root + "#header", "line": root + "#header/line/{HEADER_INDEX}", "record": root + "#record/{ROW_ID}", "call": root + "#call/{ROW_ID}",
        "sample": root + "#sample/{ROW_ID}/{SAMPLE_URI_ID}", "value": root + "#sample/{ROW_ID}/{SAMPLE_URI_ID}/fmt/{FORMAT_KEY}",
    }

    def build(name: str, source: str, subject: str, kind: str | None, **objects: str) -> TriplesMap:
        pairs = []
        for predicate, o in objects.items():
            if o in shape:
                made = Term(template=shape[o], kind="iri")
            else:
                column, _, datatype = o.partition("^")
                made = Term(reference=column, datatype=datatype or None)
            pairs.append((iri(vocabulary + predicate), made))
        return TriplesMap(name, source, Term(template=shape[subject], kind="iri"), (vocabulary + kind,) if kind else (), tuple(pairs))

    return [
        build("file", "file_metadata", "file", "VCFFile", hasHeader="header", fileFormat="FILE_FORMAT", sourceSoftware="SOURCE_SOFTWARE", referenceGenome="REFERENCE_GENOME"),
        build("header", "file_metadata", "header", "VCFHeader"),
        build("file-record", "records", "file", None, hasRecord="record"),
        build("header-line", "header_lines", "header", None, hasHeaderLine="line"),
        build("line", "header_lines", "line", "HeaderLine", headerKey="HEADER_KEY", headerValue="HEADER_VALUE"),
        build("record", "records", "record", "VCFRecord", chrom="CHROM", pos=f"POS^{XSD_INTEGER}", recordId="ID", ref="REF", alt="ALT", hasCall="call"),
        build("call", "records", "call", "VariantCall", filter="FILTER", infoRaw="INFO", formatRaw="FORMAT"),
        build("call-sample", "sample_calls", "call", None, hasSampleCall="sample"),
        build("sample", "sample_calls", "sample", "SampleCall", sampleId="SAMPLE_ID"),
        build("sample-value", "sample_format_values", "sample", None, hasFormatValue="value"),
        build("value", "sample_format_values", "value", "FormatFieldValue", fieldValue="FORMAT_VALUE"),
    ]


def with_sources(maps: list[TriplesMap], names: dict[str, str]) -> list[TriplesMap]:
    """The maps with their sources renamed, as a per-input path substitution does."""
    return [replace(m, source=names.get(m.source, m.source)) for m in maps]
