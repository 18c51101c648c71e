"""Numbers, languages and times of literals as they stand in files."""

import json

import pytest

import graphloom
from graphloom.sources import codec
from graphloom.terms import XSD, decode_term, encode_term, split_literal

T = lambda lex, dt: f'"{lex}"^^<{XSD}{dt}>'
VALUES = {
    "i": [T(3, "integer"), T(12, "integer"), T(7, "integer")],
    "d": [T("1.5", "decimal"), T("0.25", "decimal")],
    "m": [T(3, "integer"), T("0.5", "decimal")],
    "e": [T(2, "integer"), T("0.5", "double")],
    "bad": [T(2, "integer"), '"x"'],
    "big": [T(9007199254740993, "integer"), T(9007199254740992, "integer")],
    "b": [T(200, "unsignedByte")],
    "l": ['"Chat noir"@fr'],
    "k": ['"abc"@en'],
    "z1": [T("2024-01-01T10:00:00+02:00", "dateTime")],
    "z2": [T("2024-01-01T09:00:00Z", "dateTime")],
    "f": [T("2024-01-01T09:00:01.25Z", "dateTime")],
}


@pytest.fixture(scope="module")
def ds(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("terms")
    rows = [(f"u:{k}{i}", f"u:{k}", o) for k, os in VALUES.items() for i, o in enumerate(os)]
    (folder / "a.hdt").write_bytes(codec.encode(rows))
    (folder / "map.json").write_text(json.dumps({"urn:1": ["a.hdt"]}))
    return graphloom.dataset(spark, folder)


CASES = [
    ("SELECT (SUM(?v) AS ?x) {?s <u:i> ?v}", T(22, "integer")),
    ("SELECT (SUM(?v) AS ?x) {?s <u:d> ?v}", T("1.75", "decimal")),
    ("SELECT (SUM(?v) AS ?x) {?s <u:m> ?v}", T("3.5", "decimal")),
    ("SELECT (SUM(?v) AS ?x) {?s <u:e> ?v}", T("2.5", "double")),
    ("SELECT (SUM(?v) AS ?x) {?s <u:bad> ?v}", None),
    ("SELECT (SUM(?v) AS ?x) {?s <u:none> ?v}", T(0, "integer")),
    ("SELECT (SUM(?v) AS ?x) {?s <u:big> ?v}", T(18014398509481985, "integer")),
    ("SELECT (AVG(?v) AS ?x) {?s <u:m> ?v}", T("1.75", "decimal")),
    ("SELECT (AVG(?v) AS ?x) {?s <u:none> ?v}", T(0, "integer")),
    ("SELECT (?v * 2 AS ?x) {<u:i0> ?p ?v}", T(6, "integer")),
    ("SELECT (?v / 2 AS ?x) {<u:i0> ?p ?v}", T("1.5", "decimal")),
    ("SELECT (?v / 0 AS ?x) {<u:i0> ?p ?v}", None),
    ("SELECT (?v + 0.5 AS ?x) {<u:i0> ?p ?v}", T("3.5", "decimal")),
    ("SELECT (?v + 1 AS ?x) {<u:e1> ?p ?v}", T("1.5", "double")),
    ("SELECT (-?v AS ?x) {<u:i0> ?p ?v}", T(-3, "integer")),
    ("SELECT (ABS(-?v) AS ?x) {<u:d0> ?p ?v}", T("1.5", "decimal")),
    ("SELECT (?v + 1 AS ?x) {<u:b0> ?p ?v}", T(201, "integer")),
    ("SELECT (ISNUMERIC(?v) AS ?x) {<u:b0> ?p ?v}", T("true", "boolean")),
    ("SELECT (?v = ?w AS ?x) {<u:big0> ?p ?v. <u:big1> ?q ?w}", T("false", "boolean")),
    ("SELECT (?v > ?w AS ?x) {<u:big0> ?p ?v. <u:big1> ?q ?w}", T("true", "boolean")),
    ("SELECT (?v AS ?x) {?s <u:big> ?v} ORDER BY DESC(?v) LIMIT 1", T(9007199254740993, "integer")),
    ("SELECT (?v = 3.0 AS ?x) {<u:i0> ?p ?v}", T("true", "boolean")),
    ("SELECT (UCASE(?v) AS ?x) {?s <u:l> ?v}", '"CHAT NOIR"@fr'),
    ("SELECT (CONCAT(?v, ?v) AS ?x) {?s <u:k> ?v}", '"abcabc"@en'),
    ("SELECT (CONCAT(?v, ?w) AS ?x) {?s <u:k> ?v. ?t <u:l> ?w}", '"abcChat noir"'),
    ("SELECT (CONCAT(?v, \"-\") AS ?x) {?s <u:k> ?v}", '"abc-"'),
    ("SELECT (SUBSTR(?v, 2) AS ?x) {?s <u:k> ?v}", '"bc"@en'),
    ("SELECT (SUBSTR(?v, 2, 1) AS ?x) {?s <u:k> ?v}", '"b"@en'),
    ("SELECT (STRBEFORE(?v, \"b\") AS ?x) {?s <u:k> ?v}", '"a"@en'),
    ("SELECT (STRAFTER(?v, \"b\"@en) AS ?x) {?s <u:k> ?v}", '"c"@en'),
    ("SELECT (STRAFTER(?v, \"z\") AS ?x) {?s <u:k> ?v}", '""'),
    ("SELECT (STRAFTER(?v, \"b\"@fr) AS ?x) {?s <u:k> ?v}", None),
    ("SELECT (REPLACE(?v, \"b\", \"x\") AS ?x) {?s <u:k> ?v}", '"axc"@en'),
    ("SELECT (STRLEN(?v) AS ?x) {?s <u:k> ?v}", T(3, "integer")),
    ("SELECT (?a < ?b AS ?x) {?s <u:z1> ?a. ?t <u:z2> ?b}", T("true", "boolean")),
    ("SELECT (?a > ?b AS ?x) {?s <u:f> ?a. ?t <u:z2> ?b}", T("true", "boolean")),
    ("SELECT (SECONDS(?a) AS ?x) {?s <u:f> ?a}", T("1.25", "decimal")),
    ("SELECT (HOURS(?a) AS ?x) {?s <u:z1> ?a}", T(10, "integer")),
    ("SELECT (TZ(?a) AS ?x) {?s <u:z1> ?a}", '"+02:00"'),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_values(ds, text, want):
    assert list(ds.query(text)) == [(want,)]


def test_terms_by_hand():
    for term, parts in (('"a\\"b"@en-GB', ('a"b', None, "en-GB")), ('"x"^^<u:t>', ("x", "u:t", None)), ('"\\\\"', ("\\", None, None)), ('""', ("", None, None))):
        assert split_literal(term) == parts
    for bad in ("", '"', '"a', '"a"x', '"a"@', '"a"@en-', '"a"^^<u:t', '"a"^^u', 'a"', '"a\\"', '"a"@é'):
        with pytest.raises(ValueError):
            split_literal(bad)
    for term in ("u:x", "_:b1", '"a"', '"a"@en', '"1"^^<u:t>'):
        assert encode_term(*decode_term(term)) == term
