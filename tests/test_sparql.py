import duckdb
import pytest

from graphloom import queries
from graphloom.sparql import parser as p
from graphloom.terms import literal, split_literal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["tp_p", "tp_spo", "bgp_snowflake", "optional_filter", "minus", "exists_outer_filter", "subselect", "path_alt", "path_plus", "agg_empty", "fn_string", "fn_numeric", "hdt_agg_sum", "hdt_arith", "hdt_lang_string", "path_plus_to"])
def test_query_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    sql = db.sql(queries.ORACLES[name])
    at = [sql.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in sql.fetchall())


def test_parser_shapes():
    q = p.parse("PREFIX a: <urn:a:> SELECT ?x { ?x a:p/^a:q+ ?y ; a:r 1.5, 'v'@en FILTER(?y-1 > 2) } LIMIT 3 OFFSET 2")
    assert (q.limit, q.offset) == (3, 2)
    assert isinstance(q.where, p.Filter) and q.where.expr.args[0].name == "-"
    assert q.where.pattern.triples[2][2] == p.Lit("v", None, "en")


@pytest.mark.parametrize(("text", "error"), [("INSERT DATA {}", TypeError), ("SELECT ?x { SERVICE <u:x> {} }", NotImplementedError), ("SELECT ?x { ?x b:p ?y }", p.SparqlError), ("SELECT * { ?x <u:p> ?y BIND(1 AS ?y) }", p.SparqlError)])
def test_refused(text, error):
    with pytest.raises(error):
        p.parse(text)


def test_literals_round_trip():
    for lex in ('a"b\\c\nd\te', "", "é"):
        assert split_literal(literal(lex, None, "en")) == (lex, None, "en")
    with pytest.raises(ValueError):
        split_literal('"open')
