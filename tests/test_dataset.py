import json
import os

import pytest

import graphloom
from graphloom import catalog as cat
from graphloom.dataset import estimate, reorder
from graphloom.sources import codec
from graphloom.sparql import parser as ast
from tests import corpus
from tests.corpus import BIAN, CORE, KF, SD, svc

NS = {"core": CORE, "bian": BIAN, "kf": KF, "sd": SD, "xsd": "http://www.w3.org/2001/XMLSchema#"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("db"))
    corpus.write(folder)
    graphloom.build_catalog(folder)
    return folder


@pytest.fixture(scope="module")
def ds(spark, folder):
    return graphloom.dataset(spark, folder)


def test_sizes_and_files(ds):
    assert [len(g) for g in ds.graphs()] == [505, 460, 253]
    assert (len(ds), len(ds.graph("urn:none"))) == (1218, 0)
    assert len(ds.files("urn:hdt:bian", BIAN + "deprecatedBy")) == 1
    assert len(ds.files("urn:hdt:bian", BIAN + "name")) == 9
    assert ds.files("urn:hdt:bian", KF + "name") == []
    assert os.path.getsize(ds.files("urn:hdt:sd")[0]) == 874


COUNTS = [
    ("SELECT (COUNT(*) AS ?n) {?s ?p ?o}", 1218),
    ("SELECT (COUNT(*) AS ?n) {GRAPH <urn:hdt:kafka> {?t a kf:Topic}}", 63),
    ("SELECT (COUNT(*) AS ?n) {GRAPH <urn:hdt:sd> {?t a kf:Topic}}", 0),
    ("SELECT (COUNT(*) AS ?n) {GRAPH <urn:hdt:kafka> {?t kf:producedBy ?s} GRAPH <urn:hdt:sd> {?s sd:owner ?w}}", 63),
    ("SELECT (COUNT(*) AS ?n) {GRAPH <urn:hdt:bian> {?d bian:supportsService ?s} GRAPH <urn:hdt:kafka> {?t kf:producedBy ?s} GRAPH <urn:hdt:sd> {?s sd:owner ?w}}", 754),
    ("SELECT (COUNT(*) AS ?n) {?t kf:producedBy|kf:consumedBy ?s}", 126),
    ("SELECT (COUNT(DISTINCT ?t) AS ?n) {?t a kf:Topic}", 63),
    ("SELECT (SUM(xsd:integer(?p)) AS ?n) {?t kf:partitions ?p}", 438),
    ("SELECT (COUNT(*) AS ?n) {?t a kf:Topic MINUS {?t kf:compaction ?c}}", 62),
    ("SELECT (COUNT(*) AS ?n) {?d a bian:ServiceDomain FILTER NOT EXISTS {?d bian:deprecatedBy ?x}}", 71),
    ('SELECT (COUNT(*) AS ?n) {?d sd:env ?e FILTER(?e = "prod")}', 29),
    (r'SELECT (COUNT(*) AS ?n) {?t kf:name ?x FILTER(REGEX(?x, "^orders\\.") && STRLEN(?x) > 10)}', 8),
    ("SELECT (COUNT(*) AS ?n) {{?x a kf:Broker} UNION {?x a sd:Team}}", 12),
    ("SELECT (COUNT(*) AS ?n) {core:svc_orders sd:dependsOn+ ?x}", 6),
]


@pytest.mark.parametrize(("text", "n"), COUNTS)
def test_counts(ds, text, n):
    assert next(iter(graphloom.query(ds, text, NS)))[0] == f'"{n}"^^<http://www.w3.org/2001/XMLSchema#integer>'


def test_rows(ds):
    rows = lambda text: sorted(graphloom.query(ds, text, NS), key=repr)
    assert rows("SELECT ?x {core:svc_orders sd:dependsOn/sd:dependsOn ?x}") == [(svc(2),)]
    assert rows("SELECT DISTINCT ?g {GRAPH ?g {?d a sd:Deployment}}") == [("urn:hdt:sd",)]
    assert rows("SELECT ?a ?b {?a bian:deprecatedBy ?b}") == [(BIAN + "sd_1_1_0", BIAN + "sd_1_1_1")]
    found = rows("SELECT ?t ?c {?t a kf:Topic OPTIONAL {?t kf:compaction ?c}}")
    assert len(found) == 63 and [c for _, c in found if c] == ['"delete"']
    assert rows('SELECT (UCASE(?l) AS ?u) {core:svc_orders sd:label ?l}') == [('"ORDERS SERVICE"',)]


def test_forms(ds):
    assert bool(ds.query("ASK {?x a kf:Broker}", NS)) and not ds.query("ASK {?x a kf:Nothing}", NS)
    made = ds.query("CONSTRUCT {?w core:owns ?s} WHERE {?s sd:owner ?w}", NS).graph
    assert len(made) == 6 and {t[1] for t in made} == {CORE + "owns"}
    nodes = ds.query("CONSTRUCT {[] core:of ?s; core:by ?w} WHERE {?s sd:owner ?w}", NS).graph
    assert len(nodes) == 12 and len({t[0] for t in nodes}) == 6
    assert len(ds.query("CONSTRUCT {?l core:is ?s} WHERE {?s sd:label ?l}", NS).graph) == 0
    assert len(ds.query("DESCRIBE core:svc_orders", NS).graph) == 5
    with pytest.raises(TypeError):
        ds.query("INSERT DATA {<u:a> <u:b> <u:c>}")
    for write in (ds.add, ds.addN, ds.remove, ds.remove_graph):
        with pytest.raises(TypeError, match="read-only"):
            write(())
    assert ds.contexts((None, KF + "rack", None)) == ["urn:hdt:kafka"]


def test_order_of_patterns(ds):
    urns = ["urn:hdt:bian"]
    pattern = lambda p, s=ast.Var("s"): (s, ast.Iri(p) if p else ast.Var("p"), ast.Var("o" + p))
    rows = [estimate(pattern(p), ds.catalog, urns) for p in (BIAN + "deprecatedBy", BIAN + "name", KF + "none", "")]
    assert rows == [1.0, 72.0, 0.0, 505.0]
    assert estimate(pattern(BIAN + "supportsService", ast.Iri("x")), ds.catalog, urns) == 0.5
    assert estimate(pattern(BIAN + "name"), ds.catalog, ["urn:none"]) == 0
    a, b = pattern(BIAN + "name"), pattern(BIAN + "deprecatedBy")
    apart = (ast.Var("z"), ast.Iri(BIAN + "deprecatedBy"), ast.Var("y"))
    assert reorder([a, b], ds.catalog, urns) == [b, a]
    assert reorder([a, b, apart], ds.catalog, urns) == [b, a, apart]
    text = "SELECT ?n ?x {?d bian:name ?n. ?d bian:deprecatedBy ?x}"
    assert list(ds.query(text, NS)) == list(ds.query(text, NS, optimize=False))


def test_overlapping_files_are_a_set_and_graphs_a_bag(spark, tmp_path):
    t, u = ("u:a", "u:p", '"1"'), ("u:a", "u:p", '"2"')
    for name, rows in (("a", [t, u]), ("b", [t]), ("c", [t])):
        (tmp_path / f"{name}.hdt").write_bytes(codec.encode(rows))
    (tmp_path / "map.json").write_text(json.dumps({"urn:1": ["a.hdt", "b.hdt"], "urn:2": ["c.hdt"]}))
    ds = graphloom.dataset(spark, tmp_path)
    assert not (tmp_path / "map.catalog.json").exists()
    assert sorted(ds.query("SELECT ?o {?s ?p ?o}")) == [('"1"',), ('"1"',), ('"2"',)]
    assert sorted(ds.graph("urn:1").query("SELECT ?o {?s ?p ?o}")) == [('"1"',), ('"2"',)]
    assert len(ds) == 4
    assert list(graphloom.dataset(spark, tmp_path, default_union=False).query("SELECT ?o {?s ?p ?o}")) == []


def test_catalog(folder, tmp_path):
    corpus.write(tmp_path)
    m = cat.load_mapping(tmp_path)
    built = graphloom.build_catalog(tmp_path)
    again = cat.Catalog.load(m)
    assert again.stats == built.stats and again.triple_count() == 1218
    assert again.files_with_predicate("urn:hdt:sd", None) is None
    with pytest.raises(KeyError):
        again.stats_for("urn:none")
    path = m.files_for("urn:hdt:sd")[0]
    with open(path, "wb") as f:
        f.write(codec.encode([("u:a", "u:b", "u:c")]))
    now = cat.Catalog.load(m)
    assert now.triple_count("urn:hdt:sd") == 253 - 52 + 1 and now.stats["urn:hdt:bian"] == built.stats["urn:hdt:bian"]
    (tmp_path / "map.catalog.json").write_text("{")
    assert cat.Catalog.load(m).stats.keys() == built.stats.keys()


@pytest.mark.parametrize("text", ["{", "[]", '{"u": "a.hdt"}', '{"u": [1]}', '{"u": []}', '{"u": ["a.ttl"]}', '{"u": ["gone.hdt"]}', '{"u": ["a.hdt"], "u": ["a.hdt"]}'])
def test_bad_mappings(tmp_path, text):
    (tmp_path / "a.hdt").write_bytes(b"")
    (tmp_path / "map.json").write_text(text)
    with pytest.raises(cat.MappingError):
        cat.load_mapping(tmp_path)


def test_missing_mapping(tmp_path):
    with pytest.raises(cat.MappingError):
        cat.load_mapping(tmp_path)


def test_limit_reads_the_first_files_only(spark, tmp_path, monkeypatch):
    """Files whose subjects lie apart: no shuffle, and LIMIT opens no more files than it needs."""
    for i in range(9):
        (tmp_path / f"{i}.hdt").write_bytes(codec.encode([(f"u:s{i}-{k}", "u:p", f'"{k}"') for k in range(20)]))
    (tmp_path / "map.json").write_text(json.dumps({"urn:1": [f"{i}.hdt" for i in range(9)]}))
    ds = graphloom.dataset(spark, tmp_path, catalog=graphloom.build_catalog(tmp_path))
    assert not ds.catalog.may_overlap("urn:1", ds.files("urn:1"))
    assert not cat.Catalog.load(ds.mapping).may_overlap("urn:1", ds.files("urn:1"))
    plan = ds.query("SELECT ?s ?o {?s <u:p> ?o}").df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan
    for i in range(1, 9):
        os.truncate(tmp_path / f"{i}.hdt", 10)  # reading it would fail
    assert len(list(ds.query("SELECT ?s {?s <u:p> ?o} LIMIT 3"))) == 3
    assert bool(ds.query("ASK {?s <u:p> ?o}"))
    with pytest.raises(Exception, match="truncated"):
        list(ds.query("SELECT ?s {?s <u:p> ?o}"))


def test_prepared_queries(ds):
    text = "SELECT ?n ?x {?d bian:name ?n. ?d bian:deprecatedBy ?x}"
    ready = graphloom.prepare(text, ds.catalog, ["urn:hdt:bian"], NS)
    assert list(ready.run(ds)) == list(ready.run(ds)) == list(ds.query(text, NS))
    with pytest.raises(TypeError):
        graphloom.prepare("INSERT DATA {<u:a> <u:b> <u:c>}", ds.catalog)


def test_namespaces_and_close(ds):
    ds.bind("b", BIAN)
    assert (ds.namespace("b"), ds.prefix(BIAN), ("b", BIAN) in ds.namespaces()) == (BIAN, "b", True)
    assert len(ds.query("SELECT ?a {?a b:deprecatedBy ?x}")) == 1
    ds.close()
    assert len(ds.graph("urn:hdt:bian")) == 505


def test_scratch_is_never_local_on_a_cluster():
    from graphloom.sparql import scratch

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(Cluster, "x")
