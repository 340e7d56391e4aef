"""Compiler from mappings to DataFrame plans.

All maps of one table become a single ``explode(array(struct...))``, so a table
is scanned once however many maps read it, and without joins there is no
shuffle.  A template or reference with a null column makes no triple.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import RDF_TYPE, Join, MappingError, Term, TriplesMap

SCHEMA = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_language string"
_PLAIN = "^[A-Za-z0-9._~-]*$"
#: RFC 3987 characters that need no encoding in an IRI's template values.
_UNRESERVED = "^[A-Za-z0-9._~\\- -퟿豈-﷏ﷰ-￯\U00010000-\U000efffd]$"


def encode_iri(c: Column) -> Column:
    """Percent-encode everything but unreserved characters, as templates ask for."""

    def one(x: Column) -> Column:
        hexed = F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")
        return F.when(x.rlike(_UNRESERVED), x).otherwise(hexed)

    return F.when(c.rlike(_PLAIN), c).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))


def parts_of(template: str) -> list[tuple[bool, str]]:
    """(is a column, text) pieces of a template; ``\\{`` and ``\\}`` stand for braces."""
    out: list[tuple[bool, str]] = []
    for column, text in re.findall(r"\{((?:[^{}\\]|\\.)+)\}|((?:[^{}\\]|\\.)+)", template):
        out.append((bool(column), re.sub(r"\\(.)", r"\1", column or text)))
    if not out or "".join(("{%s}" % re.sub(r"([{}\\])", r"\\\1", t)) if c else re.sub(r"([{}\\])", r"\\\1", t) for c, t in out) != template:
        raise MappingError(f"malformed template {template!r}")
    return out


def columns_of(term: Term) -> list[str]:
    if term.reference is not None:
        return [term.reference]
    return [t for c, t in parts_of(term.template) if c] if term.template is not None else []


def value_of(term: Term, prefix: str = "") -> Column:
    """The lexical value of a term in a row."""
    column = lambda name: F.col(f"`{prefix}{name}`").cast("string")
    if term.constant is not None:
        return F.lit(term.constant)
    if term.reference is not None:
        return column(term.reference)
    encode = encode_iri if term.kind == "iri" else lambda c: c
    return F.concat(*[encode(column(t)) if c else F.lit(t) for c, t in parts_of(term.template)])


def _check(terms: list[Term], table: DataFrame, name: str) -> None:
    for term in terms:
        for c in columns_of(term):
            if c not in table.columns:
                raise MappingError(f"{name} refers to column {c}, which its table lacks")


def _struct(subject: Column, kind: str, predicate: Column, value: Column, o: Term, empty_as_null: bool) -> Column:
    if empty_as_null and o.kind == "literal" and o.constant is None:
        value = F.nullif(value, F.lit(""))
    return F.struct(subject.alias("s"), F.lit(kind).alias("s_kind"), predicate.alias("p"), value.alias("o"), F.lit(o.kind).alias("o_kind"), F.lit(o.datatype).cast("string").alias("o_datatype"), F.lit(o.language).cast("string").alias("o_language"))


def _joined(m: TriplesMap, p: Term, j: Join, maps: dict[str, TriplesMap], tables: dict[str, DataFrame]) -> DataFrame:
    parent = maps[j.parent]
    child, other = tables[m.source], tables[parent.source]
    other = other.select(*[F.col(f"`{c}`").alias(f"parent_{c}") for c in dict.fromkeys([*columns_of(parent.subject), *[b for _, b in j.conditions]])]).distinct()
    own = child.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns_of(m.subject), *columns_of(p), *[a for a, _ in j.conditions]])])
    if j.conditions:
        condition = None
        for a, b in j.conditions:
            same = F.col(f"`{a}`").cast("string") == F.col(f"`parent_{b}`").cast("string")
            condition = same if condition is None else condition & same
        both = own.join(other, condition)
    else:
        if m.source != parent.source:
            raise MappingError(f"{m.name} joins {parent.name} without a condition, but they have different tables")
        both = own.withColumns({f"parent_{c}": F.col(f"`{c}`") for c in columns_of(parent.subject)}) if all(c in own.columns for c in columns_of(parent.subject)) else child.withColumns({f"parent_{c}": F.col(f"`{c}`") for c in columns_of(parent.subject)})
    made = _struct(value_of(m.subject), m.subject.kind, value_of(p), value_of(parent.subject, "parent_"), Term(constant="", kind=parent.subject.kind), False)
    return both.select(made.alias("t")).select("t.*").dropDuplicates()


def compile_mapping(maps: list[TriplesMap], tables: dict[str, DataFrame], empty_as_null: bool = False, distinct: bool = False) -> DataFrame:
    """The triples of the maps as rows of ``SCHEMA``; ``distinct`` drops equal ones (a shuffle)."""
    by_name, by_source, out = {m.name: m for m in maps}, {}, []
    for m in maps:
        if m.source not in tables:
            raise MappingError(f"{m.name} reads {m.source}, which isn't one of {', '.join(sorted(tables))}")
        _check([m.subject, *[t for pair in m.pairs for t in pair if isinstance(t, Term)]], tables[m.source], m.name)
        subject, made = value_of(m.subject), by_source.setdefault(m.source, [])
        for c in m.classes:
            made.append(_struct(subject, m.subject.kind, F.lit(RDF_TYPE), F.lit(c), Term(constant=c, kind="iri"), False))
        for p, o in m.pairs:
            if isinstance(o, Join):
                out.append(_joined(m, p, o, by_name, tables))
            else:
                made.append(_struct(subject, m.subject.kind, value_of(p), value_of(o), o, empty_as_null))
    for source, made in by_source.items():
        if made:
            out.append(tables[source].select(F.explode(F.array(*made)).alias("t")).select("t.*"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    result = result.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    return result.dropDuplicates() if distinct else result


def count_by_predicate(maps: list[TriplesMap], tables: dict[str, DataFrame], empty_as_null: bool = False) -> DataFrame:
    """(p, n): how many triples each predicate has in :func:`compile_mapping`'s result.

    A triple with a constant predicate is counted where its table has the row
    that makes it, which it does unless one of its columns is null: no triple
    is made for that, and columns that can't be null aren't computed.
    """
    if any(p.constant is None or isinstance(o, Join) for m in maps for p, o in m.pairs):
        return compile_mapping(maps, tables, empty_as_null).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    by_source: dict[str, list[Column]] = {}
    for m in maps:
        if m.source not in tables:
            raise MappingError(f"{m.name} reads {m.source}, which isn't one of {', '.join(sorted(tables))}")
        _check([m.subject, *[t for pair in m.pairs for t in pair]], tables[m.source], m.name)
        for p, o in [*((RDF_TYPE, Term(constant=c, kind="iri")) for c in m.classes), *((p.constant, o) for p, o in m.pairs)]:
            made = F.lit(True)
            for c in dict.fromkeys([*columns_of(m.subject), *columns_of(o)]):
                made &= F.col(f"`{c}`").isNotNull()
            if empty_as_null and o.kind == "literal" and o.constant is None:
                made &= value_of(o) != ""
            by_source.setdefault(m.source, []).append(F.struct(F.lit(p).alias("p"), F.count_if(made).alias("n")))
    parts = [tables[source].agg(F.array(*counts).alias("t")).select(F.explode("t").alias("t")).select("t.*") for source, counts in by_source.items()]
    result = parts[0]
    for x in parts[1:]:
        result = result.unionByName(x)
    return result.groupBy("p").agg(F.sum("n").alias("n")).where("n > 0")
