"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put in a seeded random order; a row's fractional rank is
(rank - 0.5) / rows of its source. All rows are sorted by it and cut into shards of equal
numbers of rows, so each shard, and each stretch of it, has the sources in proportion.

No task sorts a source or the corpus: the random key and the fractional rank are both spread evenly,
so both are cut into many bins that are ranked on their own; the counts of the bins before
(one row for each bin) give the offset. The random key is a digest of source, id, checksum and size of the text,
and for rows equal in all of these their number among them, so that null ids and copies spread as
any others; that number is dealt by file, not in one task. Only keys are shuffled, never texts.

Defined results: a null source is a source of its own; a null id counts as an empty one in the random key; rows
equal in id, source and text are interchangeable; a null text has size 8 and checksum 0, a very long one is
read once for both; with fewer rows than shards the last shards are empty; an empty table
gives an empty result; other columns aren't read, whatever their names, but for ``carry``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

ROWS_EACH = 4_000
SEED = "graphloom"


def _before(bins: DataFrame, by: list[str], part: list[str]) -> DataFrame:
    """Adds to each bin the number of rows in the bins before it."""
    return bins.withColumn("before", F.coalesce(F.sum("rows").over(W.partitionBy(*part).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def shard(docs: DataFrame, shards: int = 24, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, stratum, size, text_crc32, shard, slot, and the columns of ``carry``."""
    text = F.col(text_col).cast("string").cast("binary")
    carry = carry or {}
    keys = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        *(c.alias(n) for n, c in carry.items()),
    )
    same = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size", "stratum")
    keys = materialize(keys.withColumn("same", same), "shard_keys").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    strata = materialize(keys.groupBy("stratum").agg(F.count(F.lit(1)).alias("of")).withColumn("bins", F.ceil(F.col("of") / ROWS_EACH)), "strata")
    n = strata.agg(F.sum("of")).first()[0] or 0
    bins = max(1, math.ceil(n / ROWS_EACH))

    # Rows that are equal in the key are numbered by file, so that none of the windows holds all of them.
    twice = keys.groupBy("same").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("same")
    files = keys.join(twice, "same", "left_semi").groupBy("same", "file").agg(F.count(F.lit(1)).alias("rows"))
    files = materialize(_before(files, ["file"], ["same"]).select("same", "file", F.col("before").alias("earlier")), "copies")
    number = F.row_number().over(W.partitionBy("same", "file").orderBy("row")) - 1 + F.coalesce("earlier", F.lit(0))
    dice = F.md5(F.concat(F.lit(f"{seed}:"), "same", F.lit(":"), number.cast("string")).cast("binary"))
    keys = keys.join(files, ["same", "file"], "left").withColumn("dice", dice).drop("same", "file", "row", "earlier")

    # Rank within the source: by bins of the random key.
    dealt = materialize(keys.join(strata, "stratum").withColumn("bin", F.floor(F.conv(F.substring("dice", 1, 8), 16, 10).cast("long") * F.col("bins") / F.lit(1 << 32)).cast("int")).drop("bins"), "dealt")
    sizes = dealt.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("rows"))
    offsets = _before(sizes, ["bin"], ["stratum"]).select("stratum", "bin", "before")
    inner = F.row_number().over(W.partitionBy("stratum", "bin").orderBy("dice"))
    ranked = dealt.withColumn("inner", inner).join(offsets, ["stratum", "bin"]).withColumn("fraction", (F.col("inner") + F.col("before") - F.lit(0.5)) / F.col("of"))

    # Position among all rows: by bins of the fractional rank.
    placed = materialize(ranked.drop("bin", "inner", "before", "of").withColumn("bin", F.least(F.floor(F.col("fraction") * bins), F.lit(bins - 1)).cast("int")), "ranked")
    steps = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))
    # One row for each ROWS_EACH rows of input goes through this window.
    starts = _before(steps, ["bin"], []).select("bin", "before")
    at = placed.withColumn("inner", F.row_number().over(W.partitionBy("bin").orderBy("fraction", "stratum", "dice"))).join(starts, "bin").withColumn("at", F.col("inner") + F.col("before") - 1)
    number = F.floor(F.col("at") * shards / F.lit(max(n, 1))).cast("int")
    # The first position of shard s is ceil(s n / shards).
    first = F.ceil(number.cast("long") * F.lit(n) / F.lit(shards)).cast("long")
    return at.select("doc_id", "stratum", "size", "text_crc32", number.alias("shard"), (F.col("at") - first).alias("slot"), *carry)
