"""Queries over the virtual RDF view, one for each operator, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Mapping
from .dataset import SparkDataset, prepare
from .sources import datasource
from .sparql.compile import Compiler, construct, describe
from .sparql.parser import Var, parse
from .sparql.scratch import folder
from .terms import TERM, lexical
from .virtual import Schema, VirtualGraphs

NS = {"c": "urn:col:", "t": "urn:tab:", "k": "urn:class:", "xsd": "http://www.w3.org/2001/XMLSchema#"}

# name: (tables, SPARQL, SQL)
_Q: dict[str, tuple[str, str, str]] = {
    "tp_p": ("nation", "SELECT ?x {?n c:n_name ?x}", "SELECT n_name AS x FROM nation"),
    "tp_po": ("orders", 'SELECT ?k {?o c:o_orderstatus "F"; c:o_orderkey ?k}', "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'"),
    "tp_sp": ("customer", "SELECT ?x {<urn:customer:7> c:c_name ?x}", "SELECT c_name AS x FROM customer WHERE c_custkey = 7"),
    "tp_spo": ("customer", 'ASK {<urn:customer:7> c:c_name "nobody"}', "SELECT EXISTS(SELECT 1 FROM customer WHERE c_custkey = 7 AND c_name = 'nobody') AS ask"),
    "tp_so": ("nation", 'SELECT ?p {<urn:nation:7> ?p "NATION_7"}', "SELECT 'urn:col:n_name' AS p FROM nation WHERE n_nationkey = 7 AND n_name = 'NATION_7'"),
    "tp_all_count": ("region nation", "SELECT (COUNT(*) AS ?n) {?s ?p ?o}", "SELECT (SELECT count(*) * 3 FROM region) + (SELECT count(*) * 5 FROM nation) AS n"),
    "bgp_star": ("orders", "SELECT ?k ?s ?p {?o c:o_orderkey ?k; c:o_orderstatus ?s; c:o_totalprice ?p}", "SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders"),
    "bgp_chain3": ("customer nation region", "SELECT ?c ?r {?x c:c_name ?c; c:c_nationkey ?n. ?n c:n_regionkey ?g. ?g c:r_name ?r}", "SELECT c_name AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "bgp_snowflake": ("lineitem orders customer nation", "SELECT ?n (COUNT(*) AS ?k) (SUM(?q) AS ?qty) {?l c:l_orderkey ?o; c:l_quantity ?q. ?o c:o_custkey ?c. ?c c:c_nationkey ?x. ?x c:n_name ?n} GROUP BY ?n", "SELECT n_name AS n, count(*) AS k, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "bgp_cartesian": ("region nation", "SELECT ?a ?b {?x c:r_name ?a. ?y c:n_name ?b}", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "group_join_graphs": ("customer nation", "SELECT ?c ?n {GRAPH t:customer {?x c:c_name ?c; c:c_nationkey ?k} GRAPH t:nation {?k c:n_name ?n}}", "SELECT c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "graph_var": ("region nation customer", "SELECT DISTINCT ?g {GRAPH ?g {?s a ?t}}", "SELECT unnest(['urn:tab:region', 'urn:tab:nation', 'urn:tab:customer']) AS g"),
    "from_named": ("region nation customer", "SELECT DISTINCT ?g FROM NAMED t:nation {GRAPH ?g {?s a ?t}}", "SELECT 'urn:tab:nation' AS g"),
    "optional": ("documents labels", "SELECT ?d ?q {?x c:n_chars ?n; c:doc_id ?d OPTIONAL {?l c:quality ?q; c:doc_id ?x}}", "SELECT d.doc_id AS d, CAST(quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "optional_filter": ("documents labels", "SELECT ?d ?q {?x c:n_chars ?n; c:doc_id ?d OPTIONAL {?l c:quality ?q; c:doc_id ?x FILTER(?n > 1000)}}", "SELECT d.doc_id AS d, CAST(quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND n_chars > 1000"),
    "filter_cmp": ("orders", "SELECT ?k {?o c:o_orderkey ?k; c:o_totalprice ?p FILTER(?p > 200000 && ?k != 5)}", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 AND o_orderkey <> 5"),
    "filter_bool": ("orders", 'SELECT ?k {?o c:o_orderkey ?k; c:o_orderstatus ?s FILTER(!(?s = "F") || ?k < 100)}', "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey < 100"),
    "filter_in": ("nation", "SELECT ?x {?n c:n_name ?x; c:n_nationkey ?k FILTER(?k IN (1, 2, 30))}", "SELECT n_name AS x FROM nation WHERE n_nationkey IN (1, 2, 30)"),
    "filter_regex": ("nation", 'SELECT ?x {?n c:n_name ?x FILTER regex(?x, "^nation_1", "i")}', "SELECT n_name AS x FROM nation WHERE regexp_matches(n_name, '^nation_1', 'i')"),
    "union_bag": ("customer supplier", "SELECT ?n {{?x c:c_name ?n} UNION {?x c:c_name ?n} UNION {?y c:s_name ?n}}", "SELECT c_name AS n FROM customer UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier"),
    "union_padded": ("region nation", "SELECT ?a ?b {{?x c:r_name ?a} UNION {?y c:n_name ?b}}", "SELECT r_name AS a, NULL AS b FROM region UNION ALL SELECT NULL, n_name FROM nation"),
    "minus": ("documents labels", "SELECT ?d {?x c:doc_id ?d; c:n_chars ?n MINUS {?l c:doc_id ?x; c:quality ?q}}", "SELECT doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "minus_disjoint": ("region nation", "SELECT ?a {?x c:r_name ?a MINUS {?y c:n_name ?b}}", "SELECT r_name AS a FROM region"),
    "exists": ("customer orders", "SELECT ?k {?c c:c_custkey ?k FILTER EXISTS {?o c:o_custkey ?c}}", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "not_exists": ("customer orders", "SELECT ?k {?c c:c_custkey ?k FILTER NOT EXISTS {?o c:o_custkey ?c}}", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "exists_outer_filter": ("customer orders", "SELECT ?k {?c c:c_custkey ?k; c:c_acctbal ?b FILTER EXISTS {?o c:o_custkey ?c; c:o_totalprice ?p FILTER(?p > 50 * ?b)}}", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50 * c_acctbal)"),
    "bind": ("orders", "SELECT ?k ?d {?o c:o_orderkey ?k BIND(?k * 2 + 1 AS ?d)}", "SELECT o_orderkey AS k, o_orderkey * 2 + 1 AS d FROM orders"),
    "values": ("nation", "SELECT ?x ?k {VALUES ?n {<urn:nation:1> <urn:nation:3>} ?n c:n_name ?x; c:n_nationkey ?k}", "SELECT n_name AS x, CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey IN (1, 3)"),
    "subselect": ("orders customer", "SELECT ?n ?m {{SELECT ?c (COUNT(*) AS ?m) {?o c:o_custkey ?c} GROUP BY ?c} ?c c:c_name ?n}", "SELECT c_name AS n, m FROM (SELECT o_custkey, count(*) AS m FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey"),
    "ask_true": ("nation", 'ASK {?n c:n_name "NATION_7"}', "SELECT EXISTS(SELECT 1 FROM nation WHERE n_name = 'NATION_7') AS ask"),
    "path_inv": ("nation region", "SELECT ?n {<urn:region:1> ^c:n_regionkey/c:n_name ?n}", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1"),
    "path_seq": ("customer nation region", "SELECT ?c ?r {?x c:c_name ?c; c:c_nationkey/c:n_regionkey/c:r_name ?r}", "SELECT c_name AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_alt": ("customer supplier", "SELECT ?n {?x (c:c_name|c:s_name) ?n}", "SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier"),
    "path_plus": ("conversations", "SELECT (COUNT(*) AS ?n) {?a c:nextTurn+ ?b}", "WITH RECURSIVE e AS (SELECT conv_id c, turn a, turn + 1 b FROM conversations x WHERE EXISTS (SELECT 1 FROM conversations y WHERE y.conv_id = x.conv_id AND y.turn = x.turn + 1)), r(c, a, b) AS (SELECT c, a, b FROM e UNION SELECT r.c, r.a, e.b FROM r JOIN e ON r.c = e.c AND r.b = e.a) SELECT count(*) AS n FROM r"),
    "agg_count": ("orders", "SELECT (COUNT(*) AS ?n) {?o c:o_orderkey ?k}", "SELECT count(*) AS n FROM orders"),
    "agg_count_distinct": ("orders", "SELECT (COUNT(DISTINCT ?c) AS ?n) {?o c:o_custkey ?c}", "SELECT count(DISTINCT o_custkey) AS n FROM orders"),
    "agg_min_max": ("orders", "SELECT ?s (MIN(?p) AS ?a) (MAX(?p) AS ?b) {?o c:o_orderstatus ?s; c:o_totalprice ?p} GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders GROUP BY 1"),
    "agg_sum_int": ("orders", "SELECT ?s (SUM(?k) AS ?t) {?o c:o_orderstatus ?s; c:o_orderkey ?k} GROUP BY ?s", "SELECT o_orderstatus AS s, CAST(sum(o_orderkey) AS BIGINT) AS t FROM orders GROUP BY 1"),
    "agg_group_concat": ("nation", 'SELECT ?r (GROUP_CONCAT(?x; SEPARATOR=", ") AS ?l) {?n c:n_name ?x; c:n_regionkey_raw ?r} GROUP BY ?r', "SELECT CAST(n_regionkey AS BIGINT) AS r, string_agg(n_name, ', ' ORDER BY n_name) AS l FROM nation GROUP BY 1"),
    "agg_sample": ("nation", "SELECT ?r (SAMPLE(?x) AS ?m) {?n c:n_name ?x; c:n_regionkey_raw ?r} GROUP BY ?r", "SELECT CAST(n_regionkey AS BIGINT) AS r, min(n_name) AS m FROM nation GROUP BY 1"),
    "agg_empty": ("nation", 'SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?s) {?x c:n_name "none"; c:n_nationkey ?k}', "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s"),
    "group_expr": ("orders", "SELECT ?y (COUNT(*) AS ?n) {?o c:o_orderdate ?d} GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "having": ("orders", "SELECT ?c (COUNT(*) AS ?n) {?o c:o_custkey ?x. ?o c:o_custkey_raw ?c} GROUP BY ?c HAVING (COUNT(*) > 12)", "SELECT CAST(o_custkey AS BIGINT) AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "agg_expr": ("orders", "SELECT ?s (COUNT(*) * 2 AS ?n) {?o c:o_orderstatus ?s} GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) * 2 AS n FROM orders GROUP BY 1"),
    "order_limit_offset": ("customer", "SELECT ?k {?c c:c_custkey ?k} ORDER BY DESC(?k) LIMIT 5 OFFSET 3", "SELECT c_custkey AS k FROM customer ORDER BY 1 DESC LIMIT 5 OFFSET 3"),
    "distinct": ("customer", "SELECT DISTINCT ?m {?c c:c_mktsegment ?m}", "SELECT DISTINCT c_mktsegment AS m FROM customer"),
    "fn_string": ("nation", 'SELECT (STRLEN(?x) AS ?l) (UCASE(?x) AS ?u) (LCASE(?x) AS ?w) (SUBSTR(?x, 2, 3) AS ?s) (CONTAINS(?x, "1") AS ?c) (STRSTARTS(?x, "NA") AS ?a) (CONCAT(?x, "!") AS ?e) {?n c:n_name ?x}', "SELECT length(n_name) AS l, upper(n_name) AS u, lower(n_name) AS w, substr(n_name, 2, 3) AS s, contains(n_name, '1') AS c, starts_with(n_name, 'NA') AS a, n_name || '!' AS e FROM nation"),
    "fn_strbefore_after": ("nation", 'SELECT (STRBEFORE(?x, "_") AS ?b) (STRAFTER(?x, "_") AS ?a) {?n c:n_name ?x}', "SELECT split_part(n_name, '_', 1) AS b, split_part(n_name, '_', 2) AS a FROM nation"),
    "fn_replace": ("nation", 'SELECT (REPLACE(?x, "[0-9]+", "#") AS ?r) {?n c:n_name ?x}', "SELECT regexp_replace(n_name, '[0-9]+', '#', 'g') AS r FROM nation"),
    "fn_numeric": ("supplier", "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) {?s c:s_suppkey ?k; c:s_acctbal ?b}", "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(s_acctbal + 0.5) AS r FROM supplier"),
    "fn_datetime": ("orders", "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?e) {?o c:o_orderkey ?k; c:o_orderdate ?d}", "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS e FROM orders"),
    "fn_hash": ("nation", "SELECT (MD5(?x) AS ?a) (SHA1(?x) AS ?b) (SHA256(?x) AS ?c) {?n c:n_name ?x}", "SELECT md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    "fn_if_coalesce": ("orders", 'SELECT ?k (IF(?k > 100, "big", "small") AS ?i) (COALESCE(?nope, ?k) AS ?c) {?o c:o_orderkey ?k}', "SELECT o_orderkey AS k, CASE WHEN o_orderkey > 100 THEN 'big' ELSE 'small' END AS i, CAST(o_orderkey AS VARCHAR) AS c FROM orders"),
    "tp_s": ("nation", "SELECT ?p ?o {<urn:nation:7> ?p ?o}", "SELECT unnest(['urn:col:n_nationkey', 'urn:col:n_name', 'urn:col:n_regionkey', 'urn:col:n_regionkey_raw', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p, unnest(['7', n_name, 'urn:region:' || n_regionkey, n_regionkey::VARCHAR, 'urn:class:Nation']) AS o FROM nation WHERE n_nationkey = 7"),
    "tp_o": ("nation region", 'SELECT ?s ?p {?s ?p "NATION_7"}', "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:col:n_name' AS p FROM nation WHERE n_name = 'NATION_7'"),
    "tp_same_var": ("nation", "SELECT ?k {?n c:n_nationkey ?k; c:n_regionkey_raw ?k}", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey = n_regionkey"),
    "optional_nested": ("documents labels", "SELECT ?d ?q ?t {?x c:n_chars ?n; c:doc_id ?d OPTIONAL {?l c:doc_id ?x; c:quality ?q OPTIONAL {?l c:toxic ?t FILTER(?t = 1)}}}", "SELECT d.doc_id AS d, CAST(quality AS BIGINT) AS q, CAST(CASE WHEN toxic = 1 THEN 1 END AS BIGINT) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "values_undef": ("nation", 'SELECT ?k {VALUES (?n ?x) {(<urn:nation:1> UNDEF) (UNDEF "NATION_3")} ?n c:n_name ?x; c:n_nationkey ?k}', "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey = 1 OR n_name = 'NATION_3'"),
    "ask_false": ("nation", 'ASK {?n c:n_name "nowhere"}', "SELECT false AS ask"),
    "construct": ("nation", "CONSTRUCT {?n k:label ?x; k:of ?r} WHERE {?n c:n_name ?x; c:n_regionkey ?r}", "SELECT 'urn:nation:' || n_nationkey AS s, unnest(['urn:class:label', 'urn:class:of']) AS p, unnest(['\"' || n_name || '\"', 'urn:region:' || n_regionkey]) AS o FROM nation"),
    "describe": ("nation region", "DESCRIBE <urn:region:1>", "SELECT 'urn:region:1' AS s, unnest(['urn:col:r_regionkey', 'urn:col:r_name', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p, unnest(['\"1\"^^<http://www.w3.org/2001/XMLSchema#integer>', '\"' || r_name || '\"', 'urn:class:Region']) AS o FROM region WHERE r_regionkey = 1"),
    "path_neg": ("nation", "SELECT ?o {?s !(c:n_name|c:n_nationkey|c:n_regionkey_raw|a) ?o}", "SELECT 'urn:region:' || n_regionkey AS o FROM nation"),
    "path_plus_to": ("conversations", "SELECT ?a {?a c:nextTurn+ <urn:conversations:1-3>}", "SELECT 'urn:conversations:' || conv_id || '-' || turn AS a FROM conversations WHERE conv_id = 1 AND turn < 3 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 1 AND turn = 3)"),
    "fn_time_parts": ("orders", "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?i) (TZ(?t) AS ?z) {?x c:o_orderkey ?k; c:o_orderdate ?d BIND(xsd:dateTime(CONCAT(SUBSTR(STR(?d), 1, 10), 'T07:08:09')) AS ?t)}", "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, 7 AS h, 8 AS i, '' AS z FROM orders"),
    "path_star": ("conversations", "SELECT ?b {<urn:conversations:1-0> c:nextTurn* ?b}", "SELECT DISTINCT 'urn:conversations:' || b AS b FROM (SELECT '1-0' AS b UNION ALL SELECT conv_id || '-' || turn FROM conversations WHERE conv_id = 1 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 1 AND turn = 0))"),
    "path_opt": ("conversations", "SELECT ?b {<urn:conversations:1-0> c:nextTurn? ?b}", "SELECT DISTINCT 'urn:conversations:' || b AS b FROM (SELECT '1-0' AS b UNION ALL SELECT '1-1' FROM conversations WHERE conv_id = 1 AND turn = 1 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 1 AND turn = 0))"),
    "agg_sum_avg": ("orders", "SELECT ?s (SUM(?k) AS ?t) (ROUND(AVG(?p)) AS ?v) {?o c:o_orderstatus ?s; c:o_orderkey ?k; c:o_totalprice ?p} GROUP BY ?s", "SELECT o_orderstatus AS s, CAST(sum(o_orderkey) AS BIGINT) AS t, floor(avg(o_totalprice) + 0.5) AS v FROM orders GROUP BY 1"),
    "agg_distinct_sum": ("orders", "SELECT ?s (SUM(DISTINCT ?c) AS ?t) {?o c:o_orderstatus ?s; c:o_custkey_raw ?c} GROUP BY ?s", "SELECT o_orderstatus AS s, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS t FROM orders GROUP BY 1"),
    "agg_count_distinct_star": ("orders", "SELECT (COUNT(DISTINCT *) AS ?n) {{SELECT ?c ?s {?o c:o_custkey ?c; c:o_orderstatus ?s}}}", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)"),
    "topk": ("orders", "SELECT ?k ?p {?o c:o_orderkey ?k; c:o_totalprice ?p} ORDER BY DESC(?p) ?k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY 2 DESC, 1 LIMIT 10"),
    "reduced": ("customer", "SELECT REDUCED ?m {?c c:c_mktsegment ?m}", "SELECT c_mktsegment AS m FROM customer"),
    "fn_encode_uri": ("nation", 'SELECT (ENCODE_FOR_URI(CONCAT(?x, " é/~*")) AS ?e) {?n c:n_name ?x}', "SELECT n_name || '%20%C3%A9%2F~%2A' AS e FROM nation"),
    "fn_round_neg": ("supplier", "SELECT ?k (ROUND(0 - ?b) AS ?r) (ROUND(-2.5) AS ?h) {?s c:s_suppkey ?k; c:s_acctbal ?b}", "SELECT s_suppkey AS k, floor(0.5 - s_acctbal) AS r, CAST(-2 AS DECIMAL(38,18)) AS h FROM supplier"),
    "fn_cast": ("nation", "SELECT (xsd:string(?k) AS ?s) (xsd:double(?k) AS ?d) (xsd:integer(?x) AS ?i) (xsd:boolean(?k) AS ?b) {?n c:n_nationkey ?k; c:n_name ?x}", "SELECT n_nationkey::VARCHAR AS s, n_nationkey::DOUBLE AS d, try_cast(n_name AS BIGINT) AS i, n_nationkey <> 0 AS b FROM nation"),
    "fn_term_tests": ("nation", "SELECT (sameTerm(?n, ?n) AS ?a) (isIRI(?n) AS ?b) (isLiteral(?x) AS ?c) (isBlank(?n) AS ?d) (isNumeric(?k) AS ?e) (isNumeric(?x) AS ?f) {?n c:n_nationkey ?k; c:n_name ?x}", "SELECT true AS a, true AS b, true AS c, false AS d, true AS e, false AS f FROM nation"),
    "fn_lang_datatype": ("nation", 'SELECT (LANG(STRLANG(?x, "en")) AS ?l) (LANG(?x) AS ?m) (DATATYPE(?k) AS ?d) (DATATYPE(?x) AS ?e) (langMatches(LANG(STRLANG(?x, "en-us")), "en") AS ?f) {?n c:n_nationkey ?k; c:n_name ?x}', "SELECT 'en' AS l, '' AS m, 'http://www.w3.org/2001/XMLSchema#integer' AS d, 'http://www.w3.org/2001/XMLSchema#string' AS e, true AS f FROM nation"),
    "fn_constructors": ("nation", 'SELECT (STR(?n) AS ?s) (IRI(CONCAT("urn:x:", ?x)) AS ?i) (STR(STRDT(?x, xsd:token)) AS ?t) {?n c:n_name ?x}', "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:x:' || n_name AS i, n_name AS t FROM nation"),
    "fn_ebv": ("nation", 'SELECT (IF(?k, 1, 0) AS ?a) (IF(?x, 1, 0) AS ?b) (IF("", 1, 0) AS ?c) {?n c:n_nationkey ?k; c:n_name ?x}', "SELECT CAST(n_nationkey <> 0 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM nation"),
}


#: Keys of the tables that the queries run on.
TABLES = Schema(
    keys={"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": ("conv_id", "turn")},
    foreign={"n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
    same={"labels.doc_id": "documents"},
    following={"conversations": ("nextTurn", "conv_id", "turn")},
)


def _run(tables: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = parse(text, NS)
        c = Compiler(spark, VirtualGraphs(spark, sf_dir, tables.split(), TABLES))
        if q.form in ("CONSTRUCT", "DESCRIBE"):
            return (construct if q.form == "CONSTRUCT" else describe)(c, q)
        rel = c.query(q)
        if q.form == "ASK":
            return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        return rel.df.select(*((lexical(rel.col(n), k) if k.name in ("iri", "term") else rel.col(n)).alias(n) for n, k in rel.kinds.items()))

    return query


def _triples(spark: SparkSession, sf_dir: str, tables: str) -> DataFrame:
    c = Compiler(spark, VirtualGraphs(spark, sf_dir, tables.split(), TABLES))
    return c.bgp(((Var("s"), Var("p"), Var("o")),), c.source.urns).as_terms({"s", "p", "o"}).df.select("s", "p", "o")


def _written(triples: DataFrame, form: str) -> list[str]:
    """Files of the triples: the rows of a subject are in one file."""
    datasource.register(triples.sparkSession)
    path = folder(triples.sparkSession, form)
    triples.repartition("s").write.format(form).mode("append").save(path)
    return datasource.listing(path, "." + form)


def hdt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasource.read(spark, "hdt", _written(_triples(spark, sf_dir, "nation region"), "hdt"), verify="true").select("s", "p", "o")


def ttl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasource.read(spark, "ttl", _written(_triples(spark, sf_dir, "nation region"), "ttl")).select("s", "p", "o")


def hdtcat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union as a set of two collections of files that overlap."""
    files = _written(_triples(spark, sf_dir, "nation region"), "hdt") + _written(_triples(spark, sf_dir, "region"), "hdt")
    merged = datasource.read(spark, "hdt", files).select("s", "p", "o").dropDuplicates()
    return datasource.read(spark, "hdt", _written(merged, "hdt")).select("s", "p", "o")


def _dataset(spark: SparkSession, sf_dir: str) -> SparkDataset:
    graphs = {"urn:tab:" + t: tuple(_written(_triples(spark, sf_dir, t), "hdt")) for t in ("nation", "region", "supplier")}
    catalog = Catalog(Mapping(graphs, "map.json"), {}, "map.catalog.json", spark)
    catalog.rebuild(save=False)
    return SparkDataset(spark, catalog.mapping, catalog)


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of each predicate of each graph, from the statistics of the files."""
    stats = [(u.urn, p, u.predicate_count(p)) for u in _dataset(spark, sf_dir).catalog for p in sorted({p for f in u.files for p in f.predicates})]
    return spark.createDataFrame(stats, "urn string, predicate string, triples bigint")


def reorder_hdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join over HDT files with its patterns in the order of their estimates."""
    return _over_files("SELECT ?s ?r {?x c:s_name ?s. ?x c:s_nationkey ?n. ?n c:n_regionkey ?g. ?g c:r_name ?r}")(spark, sf_dir)


def prepared_hdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = _dataset(spark, sf_dir)
    return _lexical(prepare("SELECT ?n ?r {?x c:n_name ?n; c:n_regionkey ?g. ?g c:r_name ?r}", ds.catalog, init_ns=NS).run(ds).df)


def hdtcat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files joined as single files: the set of their triples."""
    from .convert import hdtcat

    files = [f for tables in ("nation region", "region") for f in _written(_triples(spark, sf_dir, tables).coalesce(1), "hdt")]
    local = [f.removeprefix("file://") if f.startswith("file://") else f for f in files]
    target = f"{folder(spark, 'cat')}.hdt"
    hdtcat(local, target.removeprefix("file://") if target.startswith("file://") else target)
    return datasource.read(spark, "hdt", [target], verify="true").select("s", "p", "o")


def _lexical(df: DataFrame) -> DataFrame:
    return df.select(*(lexical(df[c], TERM).alias(c) for c in df.columns))


def _over_files(text: str, default_union: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = _dataset(spark, sf_dir)
        ds.default_union = default_union
        return _lexical(ds.query(text, NS).df)

    return query


#: Over HDT files of nation, region and supplier: text and SQL; values are lexical forms.
_HDT = {
    "hdt_limit": ("SELECT (COUNT(*) AS ?n) {SELECT ?s {?s c:s_name ?o} LIMIT 7}", "SELECT '7' AS n"),
    "hdt_optional": ("SELECT ?n ?s {?x c:n_name ?n OPTIONAL {?y c:s_nationkey ?x; c:s_name ?s}}", "SELECT n_name AS n, s_name AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey"),
    "hdt_agg_sum": ("SELECT ?g (SUM(?k) AS ?t) (COUNT(?k) AS ?n) (MIN(?k) AS ?a) (MAX(?k) AS ?b) {?x c:n_regionkey ?g; c:n_nationkey ?k} GROUP BY ?g", "SELECT 'urn:region:' || n_regionkey AS g, CAST(sum(n_nationkey) AS VARCHAR) AS t, CAST(count(*) AS VARCHAR) AS n, CAST(min(n_nationkey) AS VARCHAR) AS a, CAST(max(n_nationkey) AS VARCHAR) AS b FROM nation GROUP BY 1"),
    "hdt_arith": ("SELECT ?k (?k * 3 - 1 AS ?v) (DATATYPE(?k + 1) AS ?d) (?k / 4 AS ?q) {?x c:n_nationkey ?k}", "SELECT CAST(n_nationkey AS VARCHAR) AS k, CAST(n_nationkey * 3 - 1 AS VARCHAR) AS v, 'http://www.w3.org/2001/XMLSchema#integer' AS d, CASE n_nationkey % 4 WHEN 0 THEN n_nationkey // 4 || '.0' WHEN 1 THEN n_nationkey // 4 || '.25' WHEN 2 THEN n_nationkey // 4 || '.5' ELSE n_nationkey // 4 || '.75' END AS q FROM nation"),
    "hdt_lang_string": ('SELECT ?n (UCASE(STRLANG(?n, "en")) AS ?u) (LANG(SUBSTR(STRLANG(?n, "en"), 1, 2)) AS ?l) (LANG(CONCAT(STRLANG(?n, "en"), ?n)) AS ?m) {?x c:r_name ?n}', "SELECT r_name AS n, upper(r_name) AS u, 'en' AS l, '' AS m FROM region"),
    "hdt_filter_compare": ("SELECT ?n {?x c:n_name ?n; c:n_nationkey ?k FILTER(?k >= 7 && ?k != 9.0)}", "SELECT n_name AS n FROM nation WHERE n_nationkey >= 7 AND n_nationkey <> 9"),
    "hdt_order": ("SELECT ?n {?x c:n_name ?n; c:n_nationkey ?k} ORDER BY DESC(?k) LIMIT 4 OFFSET 1", "SELECT n_name AS n FROM nation ORDER BY n_nationkey DESC LIMIT 4 OFFSET 1"),
    "hdt_graph_var": ("SELECT ?g (COUNT(*) AS ?n) {GRAPH ?g {?s a ?c}} GROUP BY ?g", "SELECT 'urn:tab:nation' AS g, CAST(count(*) AS VARCHAR) AS n FROM nation UNION ALL SELECT 'urn:tab:region', CAST(count(*) AS VARCHAR) FROM region UNION ALL SELECT 'urn:tab:supplier', CAST(count(*) AS VARCHAR) FROM supplier"),
    "hdt_minus": ("SELECT ?n {?x c:n_name ?n MINUS {?y c:s_nationkey ?x}}", "SELECT n_name AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)"),
    "hdt_path_seq": ("SELECT ?r (COUNT(*) AS ?n) {?x c:s_nationkey/c:n_regionkey/c:r_name ?r} GROUP BY ?r", "SELECT r_name AS r, CAST(count(*) AS VARCHAR) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "hdt_not_in": ("SELECT ?n {?x c:n_name ?n; c:n_nationkey ?k FILTER(?k NOT IN (1, 2, 3))}", "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (1, 2, 3)"),
}
_PLAIN = {"hdt_no_default_graph": ("SELECT ?s {?s ?p ?o}", "SELECT r_name AS s FROM region WHERE false")}


_TRIPLES = """SELECT 'urn:nation:' || n_nationkey AS s,
  unnest(['urn:col:n_nationkey', 'urn:col:n_name', 'urn:col:n_regionkey', 'urn:col:n_regionkey_raw', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p,
  unnest(['"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', '"' || n_name || '"', 'urn:region:' || n_regionkey, '"' || n_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', 'urn:class:Nation']) AS o
FROM nation UNION ALL SELECT 'urn:region:' || r_regionkey, unnest(['urn:col:r_regionkey', 'urn:col:r_name', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']),
  unnest(['"' || r_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>', '"' || r_name || '"', 'urn:class:Region']) FROM region"""
_STATS = " UNION ALL ".join(
    f"SELECT 'urn:tab:{t}' AS urn, unnest([{', '.join(repr('urn:col:' + c) for c in columns.split())}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS predicate, count(*) AS triples FROM {t}"
    for t, columns in (("nation", "n_nationkey n_name n_regionkey n_regionkey_raw"), ("region", "r_regionkey r_name"), ("supplier", "s_suppkey s_name s_nationkey s_nationkey_raw s_acctbal"))
)
_FILES = {
    hdt_roundtrip: _TRIPLES,
    ttl_roundtrip: _TRIPLES,
    hdtcat_dedup: _TRIPLES,
    catalog_stats: _STATS,
    reorder_hdt: "SELECT s_name AS s, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    prepared_hdt: "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    hdtcat_files: _TRIPLES,
}

_BY_NAME = [({n: _run(tables, text) for n, (tables, text, _) in _Q.items()}, {n: sql for n, (_, _, sql) in _Q.items()}), ({f.__name__: f for f in _FILES}, {f.__name__: sql for f, sql in _FILES.items()})]
_BY_NAME += [({n: _over_files(text, part is _HDT) for n, (text, _) in part.items()}, {n: sql for n, (_, sql) in part.items()}) for part in (_HDT, _PLAIN)]
QUERIES = {n: f for queries, _ in _BY_NAME for n, f in queries.items()}
ORACLES = {n: sql for _, oracles in _BY_NAME for n, sql in oracles.items()}
