"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed by (source, language, topic). ``KEEP`` of all tokens are kept in expectation, whatever
the size of the cells. The kept tokens of these cells are raked in turn to the target shares of each source,
language and topic, until all three marginals hold; a cell gives its tokens at most. A category
whose target exceeds its tokens gives them all, and the others share the rest in proportion to their
targets. A cell's weight is its share of the kept tokens and its multiplier the weight over its
tokens. Each document is kept with the probability kept tokens over tokens of its cell, 1 at most,
by a seeded hash of its id: kept tokens then have these marginals in expectation, and no document
is repeated. Given targets that name too few tokens for ``KEEP`` keep as much as they name.

Targets are shares by category; without given ones they are the observed shares raised to
``temper`` and normalised, which lifts rare categories. Categories that a given target does not
name get no weight. The topic is an expression of the text (``topic_of`` by default: the
form of the text), since documents name none.

Only the cells' sums meet in the shuffle, aggregated in each task first. Raking works on the
cells, a table in the shared folder; its rounds read one row each to the driver. For each category it finds the
factor that fills the target with its cells capped, by running sums over the cells that cap first.

Defined results: nulls in source, language or topic are a category of their own; a null text has no
tokens and, as its cell's other documents, is sampled at the cell's probability; cells
without any token get probability 0 and keep nothing but where all are empty; ids may be null or
repeated (rows equal in id and text share their fate); very long texts are counted in one pass by the JVM; targets
that no cells can meet end with a warning that names the gap; an empty table gives an empty result; other
columns pass ``mix``, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

SEED = "graphloom"
#: Share of all tokens that is kept in expectation.
KEEP = 1 / 3
AXES = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """Topic by form: tables, text with license lines or code, and prose by length."""
    words = F.regexp_count(text, F.lit(WORD))
    return (
        F.when(text.isNull() | (words == 0), "none")
        .when(F.regexp_count(text, F.lit(r"\|")) * 4 > words, "table")
        .when(F.lower(text).contains("license"), "license")
        .when(words < 200, "short")
        .when(words < 2000, "article")
        .otherwise("long")
    )


def _label(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c.cast("string")))


def _targets(cells: DataFrame, axis: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    spark = cells.sparkSession
    if given is not None:
        total = sum(given.values())
        return spark.createDataFrame([("-" if k is None else f"={k}", v / total) for k, v in given.items()], f"{axis} string, share double")
    sums = cells.groupBy(axis).agg(F.sum("tokens").alias("t")).withColumn("t", F.pow("t", F.lit(temper)))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("t").alias("all")))).select(axis, (F.col("t") / F.col("all")).alias("share"))


def _wanted(cells: DataFrame, shares: dict[str, DataFrame], keep: float) -> tuple[dict[str, DataFrame], float]:
    """By axis, the kept tokens ``want`` of each category: in proportion to its share, its tokens at most; and their sum."""
    rows = {axis: materialize(cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("t")).join(shares[axis], axis, "left").fillna(0.0, ["share"]), "wanted") for axis in AXES}
    named = [r.agg(F.sum(F.when(F.col("share") > 0, F.col("t")))).first()[0] or 0.0 for r in rows.values()]
    kept = min([keep * (cells.agg(F.sum("tokens")).first()[0] or 0), *named])
    want = {}
    for axis, r in rows.items():
        # Categories at their cap only become more as the factor of the others grows.
        factor, full = kept, -1
        while True:
            capped = F.col("share") * factor >= F.col("t")
            now = r.where("share > 0").agg(F.count_if(capped).alias("full"), F.sum(F.when(capped, F.col("t"))).alias("t"), F.sum(F.when(~capped, F.col("share"))).alias("share")).first()
            if now.full == full or not now.share:
                break
            full, factor = now.full, max(factor, (kept - (now.t or 0.0)) / now.share)
        want[axis] = r.select(axis, F.when(F.col("share") > 0, F.least(F.col("t"), F.col("share") * factor)).otherwise(0.0).alias("want"))
    return want, kept


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | None], temper: float = 0.7, rounds: int = 30, tolerance: float = 1e-4, keep: float = KEEP) -> DataFrame:
    """cells (source, lang, topic, tokens) with ``kept``: tokens with the target marginals, at most those of
    the cell, and ``weight``: their shares."""
    now = cells.where("tokens > 0")
    shares = {axis: materialize(_targets(now, axis, targets.get(axis), temper), "targets") for axis in AXES}
    want, total = _wanted(now, shares, keep)
    want = {axis: materialize(w, "targets") for axis, w in want.items()}
    # kept = min(1, ratio) * tokens, where the ratio is a product of one factor for each axis.
    now = now.withColumn("ratio", F.lit(1.0))
    kept = F.least(F.col("ratio"), F.lit(1.0)) * F.col("tokens")
    for _ in range(rounds):
        for axis in AXES:
            # Cells that cap first come first: the factor is that of the first cell which then is not capped.
            first = W.partitionBy(axis).orderBy(F.desc("ratio"), *AXES)
            before = F.coalesce(F.sum("tokens").over(first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            rest = F.sum(F.col("ratio") * F.col("tokens")).over(first.rowsBetween(0, W.unboundedFollowing))
            tried = now.join(want[axis], axis).withColumn("place", F.row_number().over(first)).withColumn("factor", F.when(F.col("ratio") > 0, (F.col("want") - before) / rest))
            fits = F.when(F.col("factor") * F.col("ratio") <= 1 + 1e-9, F.struct("place", "factor"))
            all_of = W.partitionBy(axis)
            factor = F.coalesce(F.min(fits).over(all_of)["factor"], 1 / F.min(F.when(F.col("ratio") > 0, F.col("ratio"))).over(all_of), F.lit(0.0))
            now = tried.withColumn("ratio", F.col("ratio") * F.greatest(factor, F.lit(0.0))).select(*AXES, "tokens", "ratio")
        now = materialize(now, "raked")
        # After a round the last axis holds; the others tell how far it is.
        worst = 0.0
        for axis in AXES[:-1]:
            gap = now.groupBy(axis).agg(F.sum(kept).alias("sum")).join(want[axis], axis).agg(F.max(F.abs(F.col("sum") - F.col("want")))).first()[0]
            worst = max(worst, (gap or 0.0) / (total or 1.0))
        if worst < tolerance:
            break
    else:
        # Targets that no cells can meet, such as a source that has none of a language.
        warnings.warn(f"marginals still differ by {worst:.2g} of the tokens after {rounds} rounds", stacklevel=2)
    now = now.withColumn("kept", kept)
    return now.crossJoin(F.broadcast(now.agg(F.sum("kept").alias("all")))).select(*AXES, "tokens", "kept", F.when(F.col("all") > 0, F.col("kept") / F.col("all")).otherwise(0.0).alias("weight"))


def calibrated(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, temper: float = 0.7, topic: Column | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", name: str = "_mix", keep: float = KEEP) -> tuple[DataFrame, DataFrame]:
    """docs with the struct column ``name`` (source, lang, topic, tokens, dice), and the cells with
    ``multiplier`` and ``probability``."""
    text = F.col(text_col).cast("string")
    dice = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    mix = F.struct(
        _label(F.col("source")).alias("source"),
        _label(F.col("lang")).alias("lang"),
        _label(topic_of(text) if topic is None else topic).alias("topic"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        dice.alias("dice"),
    )
    rows = docs.withColumn(name, mix)
    cells = materialize(rows.groupBy(*(F.col(f"{name}.{a}").alias(a) for a in AXES)).agg(F.sum(f"{name}.tokens").alias("tokens")), "cells")
    raked = rake(cells, targets or {}, temper, keep=keep).withColumn("multiplier", F.col("weight") / F.col("tokens"))
    empty = not cells.where("tokens > 0").take(1)
    all_cells = cells.select(*AXES).join(raked.select(*AXES, "weight", "multiplier", (F.col("kept") / F.col("tokens")).alias("p")), list(AXES), "left")
    # Cells that give all their tokens keep all documents, whatever the last digits of their factors.
    probability = F.lit(1.0) if empty else F.coalesce(F.when(F.col("p") > 1 - 1e-9, F.lit(1.0)).otherwise(F.col("p")), F.lit(0.0))
    return rows, materialize(all_cells.withColumn("probability", probability).drop("p"), "multipliers")


def _with_probability(rows: DataFrame, cells: DataFrame, name: str = "_mix") -> DataFrame:
    keys = cells.select(F.struct(*AXES).alias(f"{name}_cell"), F.struct("weight", "multiplier", "probability").alias(f"{name}_p"))
    return rows.withColumn(f"{name}_cell", F.struct(*(F.col(f"{name}.{a}").alias(a) for a in AXES))).join(keys, f"{name}_cell")


def weigh(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its cell, tokens, weight, inclusion probability, and whether it is kept."""
    id_col = options.get("id_col", "doc_id")
    rows, cells = calibrated(docs, **options)
    full = _with_probability(rows.select(F.col(id_col).alias("doc_id"), "_mix"), cells)
    plain = lambda a: F.when(F.col(f"_mix.{a}") != "-", F.substr(F.col(f"_mix.{a}"), F.lit(2))).alias(a)
    return full.select("doc_id", *map(plain, AXES), F.col("_mix.tokens").alias("n_tokens"), F.col("_mix_p.weight").alias("cell_weight"), F.col("_mix_p.multiplier").alias("multiplier"), F.col("_mix_p.probability").alias("probability"), (F.col("_mix.dice") < F.col("_mix_p.probability")).alias("kept"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their columns as they were."""
    name = "_mix"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    rows, cells = calibrated(docs, name=name, **options)
    return _with_probability(rows, cells, name).where(F.col(f"{name}.dice") < F.col(f"{name}_p.probability")).select(*[F.col(f"`{c}`") for c in docs.columns])
