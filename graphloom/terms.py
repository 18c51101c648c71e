"""Terms: canonical strings, their parts, and typed columns.

A canonical term is a bare IRI, ``_:label``, or a literal in N-Triples form. A column of terms carries a
static kind, so that native values are compared and joined as such:

- ``iri``: a key; the IRI is ``prefix`` and the key;
- ``int``, ``double``, ``decimal``, ``str``, ``bool``, ``time``, ``date``: literals by their native value;
- ``term``: canonical strings of any sort.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
DATATYPES = {"int": XSD + "integer", "double": XSD + "double", "decimal": XSD + "decimal", "str": XSD + "string", "bool": XSD + "boolean", "time": XSD + "dateTime", "date": XSD + "date"}
KINDS = {v: k for k, v in DATATYPES.items()} | {XSD + k: "int" for k in ("int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")} | {XSD + "float": "double"}
NUMERIC = ("int", "decimal", "double")
SQL = {"int": "bigint", "double": "double", "decimal": "decimal(38,18)", "str": "string", "bool": "boolean", "time": "timestamp_ntz", "date": "date"}
_OUT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


@dataclass(frozen=True)
class Kind:
    name: str
    prefix: str = ""


TERM = Kind("term")


def literal(lex: str, dt: str | None = None, lang: str | None = None) -> str:
    body = '"' + re.sub(r'[\\"\n\r\t]', lambda m: _OUT[m.group()], lex) + '"'
    return body + (f"@{lang}" if lang else f"^^<{dt}>" if dt and dt != DATATYPES["str"] else "")


def split_literal(term: str) -> tuple[str, str | None, str | None]:
    """Lexical form, datatype and language of a canonical literal; ValueError if malformed."""
    from .sparql.parser import unescape

    end = 1
    while end < len(term) and term[end] != '"':
        end += 2 if term[end] == "\\" else 1
    body, tail = term[1:end], term[end + 1 :]
    closed = term[:1] == '"' and end < len(term)
    if closed and not tail:
        return unescape(body), None, None
    if closed and tail[:1] == "@":
        first, *rest = tail[1:].split("-")
        if first.isascii() and first.isalpha() and all(x.isascii() and x.isalnum() for x in rest):
            return unescape(body), None, tail[1:]
    if closed and tail[:3] == "^^<" and tail.find(">") == len(tail) - 1:
        return unescape(body), tail[3:-1], None
    raise ValueError(f"malformed literal: {term!r}")


def encode_term(lex: str, kind: str = "iri", datatype: str | None = None, language: str | None = None) -> str:
    """The canonical string of a term of a kind: iri, bnode or literal."""
    if kind == "literal":
        return literal(lex, datatype, language)
    if kind not in ("iri", "bnode"):
        raise ValueError(f"unknown kind of term: {kind}")
    return lex if kind == "iri" else f"_:{lex}"


def decode_term(term: str) -> tuple[str, str, str | None, str | None]:
    """Lexical form, kind, datatype and language of a canonical string."""
    if term.startswith('"'):
        lex, dt, lang = split_literal(term)
        return lex, "literal", dt, lang
    return (term[2:], "bnode", None, None) if term.startswith("_:") else (term, "iri", None, None)


def as_term(c: Column, kind: Kind) -> Column:
    """The canonical string of a typed column."""
    if kind.name == "term":
        return c
    if kind.name == "iri":
        return F.concat(F.lit(kind.prefix), c.cast("string"))
    return F.concat(F.lit('"'), escaped(lexical(c, kind)), F.lit('"' + ("" if kind.name == "str" else f"^^<{DATATYPES[kind.name]}>")))


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))


def unescaped(c: Column) -> Column:
    mark = "\x01"
    c = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), (mark, "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def lexical(c: Column, kind: Kind) -> Column:
    """The lexical form (for an IRI the IRI) of a typed column."""
    if kind.name == "term":
        return F.when(c.startswith('"'), unescaped(F.regexp_extract(c, r'(?s)^"((?:[^"\\]|\\.)*)"', 1))).otherwise(c)
    if kind.name == "iri":
        return as_term(c, kind)
    if kind.name == "time":
        rest = F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), rest)
    if kind.name == "decimal":
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    return c.cast("string")


def datatype(c: Column, kind: Kind) -> Column:
    if kind.name in DATATYPES:
        return F.when(c.isNotNull(), F.lit(DATATYPES[kind.name]))
    if kind.name == "iri":
        return F.lit(None).cast("string")
    dt = F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1)
    lang = F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")
    return F.when(c.startswith('"'), F.when(dt != "", dt).when(language(c, kind) != "", lang).otherwise(DATATYPES["str"]))


def language(c: Column, kind: Kind) -> Column:
    if kind.name == "term":
        return F.when(c.startswith('"'), F.lower(F.regexp_extract(c, r'"@([A-Za-z]+(?:-[A-Za-z0-9]+)*)$', 1)))
    return F.when(c.isNotNull(), F.lit(None if kind.name == "iri" else ""))


def shared(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Numeric kinds by promotion; values of several are computed in the widest.
RANKS = {"int": 0, "decimal": 1, "float": 2, "double": 3}


def rank(c: Column, kind: Kind) -> Column:
    """The number's place in RANKS; NULL if it is no number."""
    if kind.name != "term":
        return F.when(c.isNotNull() & F.lit(kind.name in NUMERIC), F.lit(RANKS.get(kind.name, 0)))
    dt = datatype(c, kind)
    of = {n: [d for d, k in KINDS.items() if k == n and d != XSD + "float"] for n in NUMERIC} | {"float": [XSD + "float"]}
    out = None
    for n, place in RANKS.items():
        test = dt.isin(*of[n])
        out = F.when(test, F.lit(place)) if out is None else out.when(test, F.lit(place))
    return F.when(native(c, kind, "double").isNotNull(), out)


def exact(c: Column, kind: Kind, sql: str) -> Column:
    """A number as an exact decimal of that type; NULL if it is none, or wider."""
    if kind.name == "term":
        return F.when(rank(c, kind) <= 1, lexical(c, kind)).try_cast(sql)
    return c.try_cast(sql) if kind.name in ("int", "decimal") else F.lit(None).cast(sql)


def number_term(place: Column, whole: Column, decimal: Column, double: Column) -> Column:
    """Canonical terms of numbers of that rank: whole is decimal(38,0), decimal is decimal(38,18)."""
    typed = lambda lex, dt: F.concat(F.lit('"'), lex, F.lit(f'"^^<{XSD}{dt}>'))
    short = lexical(decimal, Kind("decimal"))
    cases = ((0, typed(whole.cast("string"), "integer")), (1, typed(short, "decimal")), (2, typed(double.cast("float").cast("string"), "float")), (3, typed(double.cast("string"), "double")))
    out = F.lit(None).cast("string")
    for n, text in cases:
        out = F.when(place == n, text).otherwise(out)
    return out


def instant(c: Column, kind: Kind) -> Column:
    """The point in time of a dateTime; one without a zone is in UTC."""
    text = lexical(c, kind) if kind.name == "time" else F.when(datatype(c, kind) == DATATYPES["time"], lexical(c, kind))
    return F.when(F.regexp_like(text, F.lit(r"(Z|[+-]\d\d:\d\d)$")), text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def native(c: Column, kind: Kind, to: str) -> Column:
    """The value as a native column of a literal kind; NULL if it is not of that sort."""
    if kind.name == to:
        return c
    if kind.name == "term":
        text = lexical(c, kind)
        if to == "str":
            return F.when(c.startswith('"') & datatype(c, kind).isin(DATATYPES["str"], "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), text)
        kinds = [d for d, k in KINDS.items() if k == to or to in NUMERIC and k in NUMERIC]
        return F.when(datatype(c, kind).isin(*kinds), text).try_cast(SQL[to])
    if kind.name in NUMERIC and to in NUMERIC:
        return c.try_cast(SQL[to])
    return F.lit(None).cast(SQL[to])
