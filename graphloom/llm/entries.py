"""Queries of the training-data operators over whole tables, and SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, lm, mixing, rules, sharding, substring, suffix, toxicity, warc
from .common import table


def op1_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_doubling_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), 35).drop("removed")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.scratch_archive(spark)
    warc.archive(table(spark, sf_dir, "pages"), path)
    page = warc.page_of(F.col("record_id")).alias("page_id")
    full = warc.read(spark, path, kind="response").select(page, F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    digest = F.substring_index("digest", ":", -1).alias("payload_digest")
    other = warc.read(spark, path, payload=False, kind="revisit").select(page, "payload_bytes", digest, F.col("type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"))
    return full.unionByName(other)


def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(table(spark, sf_dir, "documents"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op9_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_suffixes(table(spark, sf_dir, "documents"), 200).drop("removed")


QUERIES = {f.__name__: f for f in (op1_stratified_shards, op2_deleted_interpolation, op3_benchmark_containment, op4_doubling_substrings, op5_warc, op6_raked_mixture, op7_robust_outliers, op8_jaccard_join, op9_toxic_severity, op10_suffix_repeats)}

_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

#: CRC-32 by bytes over its table, which follows from the polynomial.
_CRC = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), docs AS (SELECT doc_id, source, text, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
      lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM docs, crc)
"""

ORACLES = {
    "op1_stratified_shards": _CRC
    + """, ranked AS (
  SELECT *, coalesce('=' || source, '-') AS stratum,
    md5('graphloom:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size || ':' || coalesce('=' || source, '-') || ':' || (row_number() OVER (PARTITION BY doc_id, source, text_crc32, size) - 1)) AS dice FROM sums
), spread AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY dice) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM ranked
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, dice) - 1 AS pos, count(*) OVER () AS n FROM spread
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * 24 // n AS INTEGER) AS shard,
  CAST(pos - (pos * 24 // n * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed""",
    "op3_benchmark_containment": f"""
WITH items AS (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark), docs AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
i AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM items), d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM docs),
size AS (SELECT item_id, count(*) AS n_item_shingles FROM i GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item_shingles) AS n_item_shingles
FROM d JOIN i USING (s) JOIN size USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n_item_shingles)""",
    "op4_doubling_substrings": f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(len(w) - 34)) AS p, w FROM docs WHERE len(w) >= 35),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 35], ' ')) AS h FROM starts),
again AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT doc_id, list(p ORDER BY p) AS ps FROM again GROUP BY 1),
covered AS (SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 35)))) AS g FROM gone),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(g), 0) AS r, CASE WHEN g IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(len(w)), lambda i: NOT list_contains(g, i))), lambda i: w[i + 1]) END AS k
  FROM docs d LEFT JOIN covered c USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, sha256(html) AS d, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op8_jaccard_join": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sets AS (SELECT doc_id, {_SHINGLES} AS s FROM docs), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
d AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(u, v) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT u, b FROM reach JOIN links ON v = a)
SELECT u AS doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(v) AS component_id FROM reach JOIN sizes ON u = doc_id GROUP BY u""",
    "op10_suffix_repeats": """
WITH docs AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(len(h) // 2 - 199)) AS p, h FROM docs WHERE len(h) >= 400),
windows AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS x FROM starts),
again AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY x) > 1),
steps AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS s FROM again),
numbered AS (SELECT doc_id, p, sum(s) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM steps),
spans AS (SELECT doc_id, g, min(p) AS b, max(p) + 200 AS e FROM numbered GROUP BY 1, 2),
gaps AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS f, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS nx FROM spans),
parts AS (SELECT doc_id, sum(e - b) AS r, count(*) AS k, string_agg(substr(h, 2 * f + 1, 2 * (b - f)) || CASE WHEN nx IS NULL THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY b) AS kept
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN parts USING (doc_id)""",
}
