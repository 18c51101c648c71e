"""Turtle text to triples of canonical terms, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import urljoin

from ..terms import XSD, literal, split_literal

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
Triple = tuple[str, str, str]

_ESCAPED = r"\\[_~.\-!$&'()*+,;=/?\#@%]"
_TOKEN = re.compile(
    rf"""(?P<skip>[ \t\r\n]+|\#[^\n\r]*)|<(?P<iri>(?:[^<>"{{}}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*)>
    |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<short>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |@(?P<at>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<bnode>_:\w(?:[\w.\-]*[\w\-])?)
    |(?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)
    |(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{{2}}|{_ESCAPED})(?:(?:[\w\-:.]|%[0-9A-Fa-f]{{2}}|{_ESCAPED})*(?:[\w\-:]|%[0-9A-Fa-f]{{2}}|{_ESCAPED}))?)?)
    |(?P<word>[A-Za-z]+)|(?P<op>\^\^|[\[\]().;,])""",
    re.X | re.S,
)
_ONE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


class TurtleError(ValueError):
    """The text is not Turtle."""


def _unescape(text: str) -> str:
    def one(m):
        x = m.group(1)
        if len(x) > 1:
            return chr(int(x[1:], 16))
        if x not in _ONE:
            raise TurtleError(f"unknown escape \\{x}")
        return _ONE[x]

    return _ESCAPE.sub(one, text) if "\\" in text else text


class _Turtle:
    """Nodes without a label are named by a digest of the text and a number: the same in each run, and not
    those of another file of the graph."""

    def __init__(self, text: str, base: str):
        self.text, self.base, self.at, self.ns = text, base, 0, {}
        self.mark, self.count, self.out = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:12], 0, []
        self.kind, self.value = self.scan()

    def scan(self) -> tuple[str, str]:
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise TurtleError(f"unexpected text at line {self.text.count(chr(10), 0, self.at) + 1}: {self.text[self.at : self.at + 20]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                return m.lastgroup, m[m.lastgroup]
        return "end", ""

    def next(self) -> tuple[str, str]:
        now = self.kind, self.value
        self.kind, self.value = self.scan()
        return now

    def take(self, op: str) -> bool:
        if self.kind == "op" and self.value == op:
            self.next()
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise TurtleError(f"expected {op!r} near line {self.text.count(chr(10), 0, self.at) + 1}, found {self.value!r}")

    def fresh(self) -> str:
        self.count += 1
        return f"_:a{self.mark}n{self.count}"

    def resolve(self, iri: str) -> str:
        iri = _unescape(iri)
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) or not self.base else urljoin(self.base, iri)

    def triples(self) -> Iterator[Triple]:
        while self.kind != "end":
            if self.kind == "at" and self.value in ("prefix", "base") or self.kind == "word" and self.value.lower() in ("prefix", "base"):
                self.directive()
            else:
                bare = self.kind == "op" and self.value == "["
                s = self.node(subject=True)
                if not (bare and self.kind == "op" and self.value == "."):
                    self.properties(s)
                self.need(".")
            yield from self.out
            self.out = []

    def directive(self) -> None:
        kind, word = self.next()
        name = ""
        if word.lower() == "prefix":
            k, name = self.next()
            if k != "name" or not name.endswith(":"):
                raise TurtleError(f"not a prefix: {name!r}")
        k, iri = self.next()
        if k != "iri":
            raise TurtleError(f"expected an IRI, found {iri!r}")
        if name:
            self.ns[name[:-1]] = self.resolve(iri)
        else:
            self.base = self.resolve(iri)
        if kind == "at":
            self.need(".")

    def properties(self, s: str) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self.next()
                p = RDF + "type"
            elif self.kind in ("iri", "name"):
                p = self.node()
            else:
                raise TurtleError(f"expected a predicate, found {self.value!r}")
            while True:
                self.out.append((s, p, self.node()))
                if not self.take(","):
                    break
            more = False
            while self.take(";"):
                more = True
            if not more or self.kind == "op" and self.value in (".", "]"):
                return

    def node(self, subject: bool = False) -> str:
        kind, v = self.next()
        if kind == "iri":
            return self.resolve(v)
        if kind == "name":
            prefix, _, local = v.partition(":")
            if prefix not in self.ns:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.ns[prefix] + re.sub(r"\\(.)", r"\1", local)
        if kind == "bnode":
            return v
        if (kind, v) == ("op", "["):
            s = self.fresh()
            if not self.take("]"):
                self.properties(s)
                self.need("]")
            return s
        if (kind, v) == ("op", "("):
            items = []
            while not self.take(")"):
                items.append(self.node())
            nodes = [self.fresh() for _ in items] + [RDF + "nil"]
            for i, x in enumerate(items):
                self.out += [(nodes[i], RDF + "first", x), (nodes[i], RDF + "rest", nodes[i + 1])]
            return nodes[0]
        if subject:
            raise TurtleError(f"not a subject: {v!r}")
        if kind in ("double", "decimal", "integer"):
            return literal(v, XSD + kind)
        if kind == "word" and v in ("true", "false"):
            return literal(v, XSD + "boolean")
        if kind in ("long", "short"):
            lex = _unescape(v[3:-3] if kind == "long" else v[1:-1])
            if self.kind == "at":
                return literal(lex, None, self.next()[1].lower())
            if self.take("^^"):
                if self.kind not in ("iri", "name"):
                    raise TurtleError("expected a datatype")
                return literal(lex, self.node())
            return literal(lex)
        raise TurtleError(f"unexpected {v!r}")


def parse(text: str, base: str = "") -> Iterator[Triple]:
    """Triples in the order of the text, one statement at a time; TurtleError (a ValueError) if malformed."""
    return _Turtle(text, base).triples()


def token(term: str) -> str:
    if term.startswith("_:"):
        return term
    if term.startswith('"'):
        split_literal(term)
        return term
    return "<" + re.sub(r'[\x00-\x20<>"{}|^`\\]', lambda m: f"\\u{ord(m[0]):04X}", term) + ">"


def serialize(triples: Iterable[Triple]) -> Iterator[str]:
    """Text of triples that come sorted by subject: a statement for each subject."""
    for s, group in groupby(triples, key=lambda t: t[0]):
        yield token(s) + " " + " ;\n    ".join(f"{token(p)} {', '.join(token(t[2]) for t in part)}" for p, part in groupby(group, key=lambda t: t[1])) + " .\n"
