"""SPARQL expressions to Spark columns of a kind. An error is NULL, so SQL's three-valued logic is SPARQL's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import KINDS, NUMERIC, RANKS, SQL, TERM, XSD, Kind, as_term, datatype, escaped, exact, instant, language, lexical, native, number_term, rank, shared
from . import parser as ast

INT, DOUBLE, DECIMAL, STR, BOOL, TIME = (Kind(k) for k in ("int", "double", "decimal", "str", "bool", "time"))


class Scope(dict):
    """Columns and kinds of the variables in scope."""


def evaluate(e, scope: Scope) -> tuple[Column, Kind]:
    if isinstance(e, ast.Var):
        return scope.get(e.name, (F.lit(None).cast("string"), TERM))
    if isinstance(e, ast.Iri):
        return F.lit(e.value), TERM
    if isinstance(e, ast.Lit):
        return _constant(e)
    name, args = e.name, e.args
    if name in ("||", "&&"):
        a, b = (ebv(*evaluate(x, scope)) for x in args)
        return (a | b if name == "||" else a & b), BOOL
    if name == "!":
        return ~ebv(*evaluate(args[0], scope)), BOOL
    if name == "BOUND":
        return evaluate(args[0], scope)[0].isNotNull(), BOOL
    values = [evaluate(x, scope) for x in args]
    # Terms that are computed are evaluated once: what takes them names them many times.
    large = [i for i, (a, (_, k)) in enumerate(zip(args, values)) if k == TERM and isinstance(a, ast.Call)]
    if not large or name in ("IF", "COALESCE", "BNODE"):
        return _apply(name, values)
    kinds = []

    def body(row):
        own = list(values)
        for i in large:
            own[i] = (row[f"a{i}"], TERM)
        column, kind = _apply(name, own)
        kinds.append(kind)
        return column

    return shared(F.struct(*(values[i][0].alias(f"a{i}") for i in large)), body), kinds[0]


def _apply(name: str, values: list) -> tuple[Column, Kind]:
    if name in _COMPARE:
        return compare(name, *values), BOOL
    if name == "IN":
        return reduce(lambda x, y: x | y, (compare("=", values[0], v) for v in values[1:]), F.lit(False)), BOOL
    if name in ("+", "-", "*", "/"):
        return arithmetic(name, *values)
    if name == "NEG":
        return arithmetic("-", (F.lit(0).cast("bigint"), INT), values[0])
    if name == "IF":
        test = ebv(*values[0])
        (a, b), kind = same_kind(values[1:])
        return F.when(test.isNull(), F.lit(None)).when(test, a).otherwise(b), kind
    if name == "COALESCE":
        columns, kind = same_kind(values)
        return F.coalesce(*columns), kind
    if name.startswith(XSD):
        return cast(values[0], name[len(XSD) :])
    if name not in _FUNCTIONS:
        raise NotImplementedError(f"function {name}")
    return _FUNCTIONS[name](*values)


def _constant(e: ast.Lit) -> tuple[Column, Kind]:
    kind = "str" if e.dt is None and e.lang is None else KINDS.get(e.dt or "")
    if kind is None:
        return F.lit(ast_term(e)), TERM
    return F.lit(e.lex).try_cast(SQL[kind]) if kind != "str" else F.lit(e.lex), Kind(kind)


def ast_term(e: ast.Lit) -> str:
    from ..terms import literal

    return literal(e.lex, e.dt, e.lang)


def same_kind(values) -> tuple[list[Column], Kind]:
    kinds = {k for _, k in values}
    if len(kinds) == 1:
        return [c for c, _ in values], kinds.pop()
    if all(k.name in NUMERIC for k in kinds):
        wide = max((k.name for k in kinds), key=NUMERIC.index)
        return [native(c, k, wide) for c, k in values], Kind(wide)
    return [as_term(c, k) for c, k in values], TERM


def ebv(c: Column, kind: Kind) -> Column:
    """Effective boolean value; NULL where it is an error."""
    if kind.name == "bool":
        return c
    if kind.name == "str":
        return c != ""
    if kind.name in NUMERIC:
        return (c != 0) & ~F.isnan(c) if kind.name == "double" else c != 0
    if kind.name == "term":
        number = native(c, kind, "double")
        return F.coalesce(native(c, kind, "bool"), (number != 0) & ~F.isnan(number), native(c, kind, "str") != "")
    return F.lit(None).cast("boolean")


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(op: str, x, y) -> Column:
    (a, k), (b, m) = x, y
    f = _COMPARE[op]
    if k == m and k.name != "term":
        if k.name == "iri" and op not in ("=", "!="):
            return F.lit(None).cast("boolean")
        return f(a, b)
    if k.name in NUMERIC and m.name in NUMERIC:
        wide = max((k.name, m.name), key=NUMERIC.index)
        return f(native(a, k, wide), native(b, m, wide))
    if "term" not in (k.name, m.name):
        if op in ("=", "!=") and "iri" in (k.name, m.name):
            same = as_term(a, k) == as_term(b, m)
            return same if op == "=" else ~same
        return F.lit(None).cast("boolean")
    # At least one of unknown sort: by value for each sort that both have.
    cases = []
    if {k.name, m.name} <= {"int", "decimal", "term"}:
        # Exact numbers as such: doubles have 53 bits.
        whole = (rank(a, k) == 0) & (rank(b, m) == 0)
        cases.append(tuple(F.when(whole, exact(*x, "decimal(38,0)")) for x in ((a, k), (b, m))))
        cases.append(tuple(exact(*x, "decimal(38,18)") for x in ((a, k), (b, m))))
    if {k.name, m.name} <= {"time", "term"}:
        cases.append((instant(a, k), instant(b, m)))
    cases += [(native(a, k, to), native(b, m, to)) for to in ("double", "str", "bool", "time", "date") if k.name in (to, "term") or to == "double" and k.name in NUMERIC if m.name in (to, "term") or to == "double" and m.name in NUMERIC]
    out = None
    for p, q in cases:
        cond = p.isNotNull() & q.isNotNull()
        out = F.when(cond, f(p, q)) if out is None else out.when(cond, f(p, q))
    if op in ("=", "!="):
        s, t = as_term(a, k), as_term(b, m)
        plain = F.when(s == t, F.lit(op == "=")).when(~s.startswith('"') | ~t.startswith('"'), F.lit(op == "!="))
        return plain if out is None else out.otherwise(plain)
    return F.lit(None).cast("boolean") if out is None else out


def arithmetic(op: str, x, y) -> tuple[Column, Kind]:
    if TERM in (x[1], y[1]):
        return _term_arithmetic(op, x, y), TERM
    names = [k.name if k.name in NUMERIC else "double" for _, k in (x, y)]
    wide = max(names, key=NUMERIC.index)
    if op == "/" and wide == "int":
        wide = "decimal"
    a, b = native(*x, wide), native(*y, wide)
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    if wide == "double" and op == "/":
        return _quotient(a, b), DOUBLE
    return f(a, b).cast(SQL[wide]), Kind(wide)


def _quotient(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))).otherwise(F.try_divide(a, b))


def _term_arithmetic(op: str, x, y) -> Column:
    """By the types that the literals name: the result has the wider one; integers are divided as decimals."""
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]

    def result(row):
        p, q = row["x"], row["y"]
        place = F.when(p["rank"].isNotNull() & q["rank"].isNotNull(), F.greatest(p["rank"], q["rank"]))
        if op == "/":
            place = F.when(place == RANKS["int"], F.lit(RANKS["decimal"])).otherwise(place)
        of = lambda k, sql: f(p[k], q[k]).try_cast(sql)
        return number_term(place, of("whole", "decimal(38,0)"), of("decimal", "decimal(38,18)"), _quotient(p["double"], q["double"]) if op == "/" else f(p["double"], q["double"]))

    return shared(F.struct(_parts(x).alias("x"), _parts(y).alias("y")), result)


def _parts(x) -> Column:
    return F.struct(rank(*x).alias("rank"), exact(*x, "decimal(38,0)").alias("whole"), exact(*x, "decimal(38,18)").alias("decimal"), native(*x, "double").alias("double"))


def _term_numeric(f):
    """f of a literal's number, with its type."""
    return lambda x: shared(_parts(x), lambda v: number_term(v["rank"], f(v["whole"]).try_cast("decimal(38,0)"), f(v["decimal"]).try_cast("decimal(38,18)"), f(v["double"]).cast("double")))


def cast(x, to: str) -> tuple[Column, Kind]:
    c, kind = x
    if to == "string":
        return lexical(c, kind), STR
    name = KINDS.get(XSD + to)
    if name is None:
        raise NotImplementedError(f"cast to xsd:{to}")
    if kind.name in NUMERIC + ("bool",) and name in NUMERIC + ("bool",):
        return (c.cast("int") if kind.name == "bool" and name != "bool" else c).try_cast(SQL[name]), Kind(name)
    if kind.name == "iri":
        return F.lit(None).cast(SQL[name]), Kind(name)
    text = F.trim(lexical(c, kind))
    if name == "int":
        text = F.when(F.regexp_like(text, F.lit(r"^[+-]?\d+(\.\d*)?$")), F.regexp_extract(text, r"^([+-]?\d+)", 1))
    return text.try_cast(SQL[name]), Kind(name)


def order_keys(c: Column, kind: Kind, down: bool | None) -> list[Column]:
    """Sort keys: unbound, blank nodes, IRIs, literals by value. down None: as plain columns."""
    if kind.name == "term":
        order = F.when(c.isNull(), 0).when(c.startswith("_:"), 1).when(c.startswith('"'), 3).otherwise(2)
        keys = [order, native(c, kind, "double"), exact(c, kind, "decimal(38,18)"), instant(c, kind), F.coalesce(native(c, kind, "str"), c)]
    else:
        keys = [c]
    return keys if down is None else [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]


def _text(x) -> Column:
    """The string of a string literal, with or without a language."""
    return native(*x, "str") if x[1].name in ("str", "term") else F.lit(None).cast("string")


def _tag(x) -> Column:
    """The language tag with its mark, of a literal as it is written; empty without."""
    return F.when(x[0].isNotNull(), F.regexp_extract(x[0], r'"(@[A-Za-z]+(?:-[A-Za-z0-9]+)*)$', 1) if x[1] == TERM else F.lit(""))


def _like(x, text: Column):
    """A text with the language of x."""
    return (F.concat(F.lit('"'), escaped(text), F.lit('"'), _tag(x)), TERM) if x[1] == TERM else (text, STR)


def _second(x, y) -> Column:
    """The string of y, where its language is none or that of x."""
    text = _text(y)
    if y[1] != TERM:
        return text
    return F.when((_tag(y) == "") | (F.lower(_tag(y)) == F.lower(_tag(x))), text)


def _of_text(f):
    return lambda x: (f(_text(x)), STR)


def _same_language(f):
    return lambda x: _like(x, f(_text(x)))


def _numeric(f):
    def run(x):
        c, kind = x
        if kind == TERM:
            return _term_numeric(f)(x), TERM
        if kind.name not in NUMERIC:
            c, kind = native(c, kind, "double"), DOUBLE
        return f(c).cast(SQL[kind.name]), kind

    return run


def _time(x) -> Column:
    c, kind = x
    if kind.name in ("time", "date"):
        return c
    text = F.when(datatype(c, kind).isin(XSD + "dateTime", XSD + "date"), lexical(c, kind))
    return F.regexp_replace(text, r"(Z|[+-]\d\d:\d\d)$", "").try_cast("timestamp_ntz")


def _part(f):
    return lambda x: (f(_time(x)).cast("bigint"), INT)


def _zone(x) -> Column:
    return F.regexp_extract(lexical(*x), r"(Z|[+-]\d\d:\d\d)$", 1)


def _pattern(p: Column, flags) -> Column:
    if flags is None:
        return p
    text = _text(flags)
    quoted = F.when(F.contains(text, F.lit("q")), F.concat(F.lit("\\Q"), p, F.lit("\\E"))).otherwise(p)
    keep = F.regexp_replace(text, "[^ismx]", "")
    return F.concat(F.when(keep != "", F.concat(F.lit("(?"), keep, F.lit(")"))).otherwise(""), quoted)


def _regex(s, p, flags=None):
    return F.regexp_like(_text(s), _pattern(_text(p), flags)), BOOL


def _replace(s, p, r, flags=None):
    return _like(s, F.regexp_replace(_text(s), _pattern(_text(p), flags), _text(r)))


def _substr(s, start, length=None):
    text, a = _text(s), native(*start, "int").cast("int")
    if length is None:
        return _like(s, F.substr(text, F.greatest(a, F.lit(1))))
    end = a + native(*length, "int").cast("int")
    first = F.greatest(a, F.lit(1))
    return _like(s, F.substr(text, first, F.greatest(end - first, F.lit(0))))


def _cut(s, t, part):
    """Part of s beside its first t; where t is not in s, an empty string without language."""
    a, b = _text(s), _second(s, t)
    at = F.position(b, a)
    found, kind = _like(s, part(a, b, at))
    return F.when(at > 0, found).when(a.isNotNull() & b.isNotNull(), '""' if kind == TERM else ""), kind


def _before(s, t):
    return _cut(s, t, lambda a, b, at: F.substr(a, F.lit(1), at - 1))


def _after(s, t):
    return _cut(s, t, lambda a, b, at: F.substr(a, at + F.char_length(b)))


def _concat(*xs):
    if not xs:
        return F.lit(""), STR
    text = F.concat(*map(_text, xs))
    if any(k != TERM for _, k in xs):
        return text, STR
    tags = [_tag(x) for x in xs]
    same = reduce(lambda p, q: p & q, (F.lower(t) == F.lower(tags[0]) for t in tags))
    return F.concat(F.lit('"'), escaped(text), F.lit('"'), F.when(same, tags[0]).otherwise("")), TERM


def _is(test):
    return lambda x: (F.when(x[0].isNotNull(), test(as_term(*x))), BOOL)


def _numeric_test(x):
    return F.when(x[0].isNotNull(), native(*x, "double").isNotNull() if x[1].name == "term" else F.lit(x[1].name in NUMERIC)), BOOL


def _same_term(x, y):
    if x[1] == y[1]:
        return x[0] == y[0], BOOL
    return as_term(*x) == as_term(*y), BOOL


def _iri(x):
    return F.when(~as_term(*x).startswith("_:"), lexical(*x)), TERM


def _strdt(s, d):
    return F.concat(F.lit('"'), escaped(_text(s)), F.lit('"^^<'), as_term(*d), F.lit(">")), TERM


def _strlang(s, tag):
    return F.concat(F.lit('"'), escaped(_text(s)), F.lit('"@'), F.lower(_text(tag))), TERM


def _lang_matches(tag, want):
    a, b = F.lower(_text(tag)), F.lower(_text(want))
    return F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-")))), BOOL


def _encode(x):
    return F.replace(F.replace(F.replace(F.url_encode(_text(x)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), STR


def _seconds(x):
    t = _time(x)
    return F.expr("0").cast("decimal(38,18)") + F.date_part(F.lit("SECOND"), t).cast("decimal(38,18)"), DECIMAL


def _timezone(x):
    z = _zone(x)
    hours, minutes = F.regexp_extract(z, r"[+-](\d\d)", 1).try_cast("int"), F.regexp_extract(z, r":(\d\d)", 1).try_cast("int")
    sign = F.when(z.startswith("-"), "-").otherwise("")
    body = F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    text = F.when((z == "Z") | ((hours == 0) & (minutes == 0)), "PT0S").when(z != "", body)
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}dayTimeDuration>')), TERM


def _bnode(x=None):
    return F.concat(F.lit("_:b"), F.replace(F.uuid(), F.lit("-"), F.lit("")) if x is None else F.md5(F.concat(F.uuid(), _text(x)))), TERM


_FUNCTIONS = {
    "STR": lambda x: (F.when(~as_term(*x).startswith("_:"), lexical(*x)), STR),
    "LANG": lambda x: (language(*x), STR),
    "DATATYPE": lambda x: (datatype(*x), TERM),
    "LANGMATCHES": _lang_matches,
    "IRI": _iri,
    "URI": _iri,
    "BNODE": _bnode,
    "STRDT": _strdt,
    "STRLANG": _strlang,
    "UUID": lambda: (F.concat(F.lit("urn:uuid:"), F.uuid()), TERM),
    "STRUUID": lambda: (F.uuid(), STR),
    "ISIRI": _is(lambda t: ~t.startswith('"') & ~t.startswith("_:")),
    "ISURI": _is(lambda t: ~t.startswith('"') & ~t.startswith("_:")),
    "ISBLANK": _is(lambda t: t.startswith("_:")),
    "ISLITERAL": _is(lambda t: t.startswith('"')),
    "ISNUMERIC": _numeric_test,
    "SAMETERM": _same_term,
    "STRLEN": lambda x: (F.char_length(_text(x)).cast("bigint"), INT),
    "SUBSTR": _substr,
    "UCASE": _same_language(F.upper),
    "LCASE": _same_language(F.lower),
    "STRSTARTS": lambda a, b: (F.startswith(_text(a), _second(a, b)), BOOL),
    "STRENDS": lambda a, b: (F.endswith(_text(a), _second(a, b)), BOOL),
    "CONTAINS": lambda a, b: (F.contains(_text(a), _second(a, b)), BOOL),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "CONCAT": _concat,
    "ENCODE_FOR_URI": _encode,
    "REGEX": _regex,
    "REPLACE": _replace,
    "ABS": _numeric(F.abs),
    "CEIL": _numeric(F.ceil),
    "FLOOR": _numeric(F.floor),
    "ROUND": _numeric(lambda c: F.floor(c + F.lit(0.5))),
    "RAND": lambda: (F.rand(), DOUBLE),
    "NOW": lambda: (F.current_timestamp().cast("timestamp_ntz"), TIME),
    "YEAR": _part(F.year),
    "MONTH": _part(F.month),
    "DAY": _part(F.day),
    "HOURS": _part(F.hour),
    "MINUTES": _part(F.minute),
    "SECONDS": _seconds,
    "TZ": lambda x: (F.when(_time(x).isNotNull(), _zone(x)), STR),
    "TIMEZONE": _timezone,
    "MD5": _of_text(lambda t: F.md5(t.cast("binary"))),
    "SHA1": _of_text(lambda t: F.sha1(t.cast("binary"))),
    **{f"SHA{n}": _of_text(lambda t, n=n: F.sha2(t.cast("binary"), n)) for n in (256, 384, 512)},
}
