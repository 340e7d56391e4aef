"""Reader of the part of Turtle that mapping documents use, and of mappings in it."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from .mapping import RML, RR, Join, MappingError, Term, TriplesMap

_LEXER = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\r\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<string>"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<typed>\^\^)
    |(?P<blank>_:[\w.-]*\w)
    |(?P<name>[A-Za-z][\w.-]*:(?:[\w%:-][\w.%:/-]*[\w%/-]|[\w%]|(?=\W|$))|:(?:[\w%-]+)?|[A-Za-z]+)
    |(?P<punct>[][();,.])""",
    re.VERBOSE,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
NIL, REST, FIRST = (f"http://www.w3.org/1999/02/22-rdf-syntax-ns#{x}" for x in ("nil", "rest", "first"))
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _unescape(raw: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        return chr(int(x[1:], 16)) if x[0] in "uU" else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, raw, flags=re.DOTALL)


class Literal(str):
    """A literal, told apart from an IRI."""

    __slots__ = ()


class _Parser:
    def __init__(self, text: str, base: str) -> None:
        self.base, self.prefixes, self.blanks = base, {}, 0
        self.triples: list[tuple[str, str, str]] = []
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _LEXER.match(text, at)
            if not m:
                raise MappingError(f"line {text.count(chr(10), 0, at) + 1}: can't read {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group(), text.count("\n", 0, at) + 1))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise MappingError("the document ends within a statement")
        kind, value, line = self.tokens[self.at]
        if wanted is not None and value != wanted:
            raise MappingError(f"line {line}: expected {wanted!r}, found {value!r}")
        self.at += 1
        return kind, value

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def run(self) -> list[tuple[str, str, str]]:
        while self.at < len(self.tokens):
            word = self.peek()
            if word.lower() in ("@prefix", "prefix", "@base", "base"):
                self.take()
                if word.lower().endswith("prefix"):
                    name = self.take()[1]
                    self.prefixes[name.rstrip(":")] = self.resolve(self.take()[1])
                else:
                    self.base = self.resolve(self.take()[1])
                if word.startswith("@"):
                    self.take(".")
                continue
            subject = self.node()
            if self.peek() != ".":
                self.properties(subject)
            self.take(".")
        return self.triples

    def resolve(self, token: str) -> str:
        inner = _unescape(token[1:-1])
        return inner if re.match(r"[A-Za-z][\w+.-]*:", inner) else self.base + inner if inner.startswith("#") else urljoin(self.base, inner)

    def properties(self, subject: str) -> None:
        while True:
            kind, value = self.tokens[self.at][:2]
            predicate = TYPE if value == "a" and self.take() else self.node()
            while True:
                self.triples.append((subject, predicate, self.node()))
                if self.peek() != ",":
                    break
                self.take(",")
            if self.peek() != ";":
                return
            while self.peek() == ";":
                self.take(";")
            if self.peek() in (".", "]", ""):
                return

    def node(self) -> str:
        kind, value = self.take()
        if kind == "iri":
            return self.resolve(value)
        if kind in ("string", "long"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek() == "^^":
                self.take()
                self.node()
            elif self.at < len(self.tokens) and self.tokens[self.at][0] == "at":
                self.take()
            return Literal(text)
        if kind == "number" or value in ("true", "false"):
            return Literal(value)
        if kind == "blank":
            return value
        if value == "[":
            subject = self.fresh()
            if self.peek() != "]":
                self.properties(subject)
            self.take("]")
            return subject
        if value == "(":
            items = []
            while self.peek() != ")":
                items.append(self.node())
            self.take(")")
            head = NIL
            for item in reversed(items):
                cell = self.fresh()
                self.triples += [(cell, FIRST, item), (cell, REST, head)]
                head = cell
            return head
        if kind == "name" and ":" in value:
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise MappingError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        raise MappingError(f"line {self.tokens[self.at - 1][2]}: unexpected {value!r}")


def parse(text: str, base: str = "urn:mapping") -> list[tuple[str, str, str]]:
    """The statements of a Turtle document, in order."""
    return _Parser(text, base).run()


#: Constructs that are read; any other of these vocabularies is refused by name.
_KNOWN = {
    RR + x
    for x in (
        "subjectMap", "subject", "predicateObjectMap", "predicate", "predicateMap", "object", "objectMap", "template", "class", "constant", "datatype",
        "language", "termType", "parentTriplesMap", "joinCondition", "child", "parent",
    )
} | {RML + x for x in ("logicalSource", "source", "referenceFormulation", "reference", "iterator")}
_KINDS = {RR + "IRI": "iri", RR + "Literal": "literal", RR + "BlankNode": "blank"}


def to_turtle(maps: list[TriplesMap]) -> str:
    """A mapping document that :func:`load_mapping` reads as these maps; a start for one's own."""
    quoted = lambda x: '"' + re.sub(r'["\\\\]', lambda m: "\\" + m.group(), x).replace("\n", "\\n").replace("\r", "\\r") + '"'

    def term(t: Term) -> str:
        said = [f"rr:template {quoted(t.template)}"] if t.template is not None else [f"rml:reference {quoted(t.reference)}"] if t.reference is not None else [f"rr:constant {f'<{t.constant}>' if t.kind == 'iri' else quoted(t.constant)}"]
        said += [f"rr:termType rr:{dict(iri='IRI', literal='Literal', blank='BlankNode')[t.kind]}"]
        said += [f"rr:datatype <{t.datatype}>"] if t.datatype else []
        return " ; ".join(said + ([f"rr:language {quoted(t.language)}"] if t.language else []))

    def target(o: Term | Join) -> str:
        if isinstance(o, Term):
            return term(o)
        return f"rr:parentTriplesMap <#{o.parent.rpartition('#')[2]}>" + "".join(f" ; rr:joinCondition [ rr:child {quoted(a)} ; rr:parent {quoted(b)} ]" for a, b in o.conditions)

    out = [f"@prefix rr: <{RR}> .", f"@prefix rml: <{RML}> ."]
    for m in maps:
        classes = "".join(f" ; rr:class <{c}>" for c in m.classes)
        lines = [f"<#{m.name.rpartition('#')[2]}> rml:logicalSource [ rml:source {quoted(m.source + '.tsv')} ]", f"  rr:subjectMap [ {term(m.subject)}{classes} ]"]
        lines += [f"  rr:predicateObjectMap [ rr:predicateMap [ {term(p)} ] ; rr:objectMap [ {target(o)} ] ]" for p, o in m.pairs]
        out.append(" ;\n".join(lines) + " .")
    return "\n\n".join(out) + "\n"


def load_mapping(text: str) -> list[TriplesMap]:
    """The triples maps of a mapping document; unsupported constructs are an error that names them."""
    triples = parse(text)
    graph: dict[str, dict[str, list[str]]] = {}
    for s, p, o in triples:
        if p.startswith((RR, RML)) and p not in _KNOWN:
            raise MappingError(f"unsupported construct {p} at {s}")
        graph.setdefault(s, {}).setdefault(p, []).append(o)

    def one(s: str, p: str) -> str | None:
        found = graph.get(s, {}).get(p, [])
        if len(found) > 1:
            raise MappingError(f"{s} has more than one {p}")
        return found[0] if found else None

    def source(s: str) -> str:
        logical = one(s, RML + "logicalSource")
        at = one(logical, RML + "source") if logical else None
        if at is None:
            raise MappingError(f"{s} has no logical source")
        if not isinstance(at, Literal):
            at = next((o[0] for p, o in graph.get(at, {}).items() if p.rpartition("#")[2] == "url"), None)
            if at is None:
                raise MappingError(f"the source of {s} has no url")
        return re.sub(r"^(.*[/.])?(?=[^/.]+\.[A-Za-z]+$)", "", at).rpartition(".")[0] or at

    def term(s: str, default: str) -> Term:
        found = [(k, v) for k, ns in (("template", RR), ("reference", RML), ("constant", RR)) if (v := one(s, ns + k)) is not None]
        if len(found) != 1:
            raise MappingError(f"{s} needs one of template, reference and constant")
        kind, (name, value) = one(s, RR + "termType"), found[0]
        datatype, language = one(s, RR + "datatype"), one(s, RR + "language")
        natural = "iri" if name == "template" or name == "constant" and not isinstance(value, Literal) else "literal" if datatype or language or name == "constant" else default
        if kind is not None and kind not in _KINDS:
            raise MappingError(f"unknown term type {kind}")
        return Term(**{name: str(value)}, kind=_KINDS[kind] if kind else natural, datatype=datatype, language=language)

    def constant(value: str) -> Term:
        return Term(constant=str(value), kind="literal" if isinstance(value, Literal) else "iri")

    maps = []
    for s, properties in graph.items():
        if RML + "logicalSource" not in properties:
            continue
        at = one(s, RR + "subjectMap")
        if at is None and (fixed := one(s, RR + "subject")) is None:
            raise MappingError(f"{s} has no subject")
        subject = term(at, "iri") if at is not None else constant(fixed)
        if subject.kind == "literal":
            raise MappingError(f"the subject of {s} is a literal")
        pairs = []
        for pom in properties.get(RR + "predicateObjectMap", []):
            g = graph.get(pom, {})
            predicates = [constant(p) for p in g.get(RR + "predicate", [])] + [term(p, "iri") for p in g.get(RR + "predicateMap", [])]
            objects: list[Term | Join] = [constant(o) for o in g.get(RR + "object", [])]
            for o in g.get(RR + "objectMap", []):
                if parent := one(o, RR + "parentTriplesMap"):
                    conditions = [(one(j, RR + "child"), one(j, RR + "parent")) for j in graph[o].get(RR + "joinCondition", [])]
                    if any(None in c for c in conditions):
                        raise MappingError(f"a join condition of {s} lacks child or parent")
                    objects.append(Join(parent, tuple((str(a), str(b)) for a, b in conditions)))
                else:
                    objects.append(term(o, "literal"))
            if not predicates or not objects:
                raise MappingError(f"a predicate-object map of {s} is incomplete")
            pairs += [(p, o) for p in predicates for o in objects]
        classes = tuple(graph.get(at, {}).get(RR + "class", ())) if at is not None else ()
        maps.append(TriplesMap(s, source(s), subject, classes, tuple(pairs)))
    if not maps:
        raise MappingError("the document has no triples map")
    names = {m.name for m in maps}
    for m in maps:
        for _, o in m.pairs:
            if isinstance(o, Join) and o.parent not in names:
                raise MappingError(f"{m.name} refers to {o.parent}, which isn't a triples map")
    return maps
