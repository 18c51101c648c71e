"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each document has counts of its words, characters and repeats (``statistics``). Documents that pass the
base rules are described by three transformed statistics: the log of the mean word length, the log of the
marks (characters that are no letter, digit or space, symbols among them) per word, and the log of its repetition:
words that occurred before, words in repeated windows and ``LINE`` words for each repeated line, over a power of the
words, as a vocabulary grows with a text. Each is a rate of the text with ``PRIOR`` common words added, so that
short texts scatter no more than long ones. All three vary in any prose, so the data set the scatter.

Minimum-covariance-determinant estimates of location and scatter are made at three levels: all documents, each
language, each language and source; equal vectors of a group (copies) count once. From each of ``STARTS``
(medians and deviations, the moments of all, medians and spatial signs) concentration steps keep the nearest
``SUBSET`` of the group and estimate again, until the determinant falls no more (by 1e-6 of it); of a group's
starts the one with the least determinant counts. The scatter is then made consistent by the median distance.
A language's estimate is weighted by its number n of vectors against that of all documents, n to ``SHRINK``, and a
source's against its language's in the same way, so there is no least size of a group; that of all documents is
drawn towards unit variances with weight exp(-n / 20), which only tables of some dozen documents feel. A
document is rejected if its squared Mahalanobis distance exceeds ``CUT``, a quantile of chi-square.

A concentration step is one aggregation: sums of the statistics by group, start and class of distance (half a
percent wide), from which the nearest classes are summed; of the class at the edge the fraction that fills the
subset. So a group may hold any share of the rows: it is joined with its estimates in ``PARTS`` parts, and
there is no sort of a group and no collection of it.
Repeats within a document are found in its own array of window hashes (64 bits).

Defined results: a null text has no words, so it fails the base rules; nulls in language and
source form groups of their own; ids may be null or repeated; rows with equal text in one group share
their verdict; a very long text is an array of its words in one task, whole; an empty table gives an
empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, let, materialize

SUBSET, SHRINK = 0.75, 60
#: Words of 5 letters with 0.14 marks each that are added to a text; words that a repeated line counts for.
PRIOR, LINE, GROWTH = 200, 10, 1.3
STARTS = ("median", "moments", "signs")
#: Quantile of chi-square with 3 degrees of freedom at 1 - 1e-8, and its median.
CUT, MEDIAN = 40.13, 2.366
#: Least variance, for the inverse's sake; most steps of a start that still falls.
FLOOR, STEPS = 1e-6, 40
_X = ("x0", "x1", "x2")
#: Parts of each group in joins with its estimates.
PARTS = 64
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_EST = [*(f"m{i}" for i in range(3)), *(f"c{i}{j}" for i, j in _PAIRS)]


def repeated_words(words: Column, k: int = 5) -> Column:
    """Number of words in windows of k words that occur twice or more in the array."""

    def of(hashes: Column) -> Column:
        # Starts of repeated windows: neighbours with equal hashes once sorted by (hash, start).
        def starts(pairs: Column) -> Column:
            found = F.filter(pairs, lambda x, i: F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)))
            return let(F.array_sort(F.transform(found, lambda x: x["i"])), lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(k)), F.lit(k))), F.lit(0), lambda a, b: a + b))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, starts))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        return F.when(F.size(w) > k, let(hashes, of)).otherwise(F.lit(0))

    return let(words, windows).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """Counts of a text, 0 for null: the base statistics, marks and distinct words."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    dups = let(F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD))), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    return {
        "n_words": zero(F.regexp_count(text, F.lit(WORD))),
        "word_chars": zero(F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))),
        "n_symbols": zero(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))),
        "n_dup_lines": zero(F.when(text.isNotNull(), dups)),
        "n_repeat_words": zero(F.when(text.isNotNull(), repeated_words(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))),
        "n_marks": zero(F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\s]"))),
        "n_distinct": zero(F.when(text.isNotNull(), F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))))),
    }


def vector() -> list[Column]:
    """The transformed statistics of the counts of a document."""
    n = F.col("n_words") + F.lit(float(PRIOR))
    repeats = F.col("n_words") - F.col("n_distinct") + F.col("n_repeat_words") + LINE * F.col("n_dup_lines")
    # A thirtieth of n ** GROWTH is what prose repeats.
    return [F.log((F.col("word_chars") + 5 * PRIOR) / n), F.log((F.col("n_marks") + 0.14 * PRIOR) / n), F.log(repeats + PRIOR**GROWTH / 30) - GROWTH * F.log(n)]


def _c(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def _matrix() -> tuple[dict, Column]:
    """The covariance matrix with its least variances, and its determinant."""
    c = {(i, j): F.col(_c(i, j)) + (FLOOR if i == j else 0.0) for i in range(3) for j in range(3)}
    return c, sum((c[0, j] * _cofactor(c, 0, j) for j in (1, 2)), c[0, 0] * _cofactor(c, 0, 0))


def _cofactor(c: dict, i: int, j: int) -> Column:
    (r, s), (t, u) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    return (c[r, t] * c[s, u] - c[r, u] * c[s, t]) * (-1) ** (i + j)


def _distance() -> Column:
    """Squared Mahalanobis distance by the inverse of the 3 x 3 covariance matrix."""
    c, det = _matrix()
    y = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(_X)]
    return sum((y[i] * y[j] * _cofactor(c, i, j) * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0)) / det


def _class(d: Column) -> Column:
    """Classes of distance: ever wider by half a percent."""
    return F.floor(F.log1p(F.least(F.greatest(d, F.lit(0.0)), F.lit(1e12))) * 200).cast("int")


def _sums(weight: Column | None = None) -> list[Column]:
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w).alias("n"), *(F.sum(F.col(x) * w).alias(f"s{i}") for i, x in enumerate(_X)), *(F.sum(F.col(_X[i]) * F.col(_X[j]) * w).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _moments(sums: DataFrame, *keys: str) -> DataFrame:
    """Means m and covariances c of sums n, s and q."""
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    return sums.select(*keys, *(F.round(mean(i), 12).alias(f"m{i}") for i in range(3)), *(F.round(F.col(f"q{i}{j}") / F.col("n") - mean(i) * mean(j), 15).alias(f"c{i}{j}") for i, j in _PAIRS))


def _with(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined by grp with one or few rows of each group; a group with most of the rows is joined in parts."""
    salt = F.pmod(F.xxhash64(*_X), F.lit(PARTS)).cast("int")
    each = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", salt).join(each, ["grp", "part"], how).drop("part")


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates (grp, start, m, c), with the rows of each group as ``all``."""
    places = 3
    centre = materialize(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("all"), *(F.percentile(F.round(x, places), F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(_X))), "medians")
    apart = _with(rows, centre)
    spread = materialize(apart.groupBy("grp").agg(*(F.greatest(F.percentile(F.abs(F.round(F.col(x) - F.col(f"m{i}"), places)), F.lit(0.5)) * 1.4826, F.lit(10.0**-places)).alias(f"d{i}") for i, x in enumerate(_X))), "deviations")
    base = centre.join(spread, "grp")
    median = base.select("grp", "all", F.lit(STARTS[0]).alias("start"), *(f"m{i}" for i in range(3)), *((F.pow(f"d{i}", F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS))
    moments = _moments(rows.groupBy("grp").agg(*_sums()), "grp").join(centre.select("grp", "all"), "grp").select("grp", "all", F.lit(STARTS[1]).alias("start"), *_EST)
    # Directions from the medians, whatever the distance; in units of the deviations.
    unit = [(F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}") for i, x in enumerate(_X)]
    length = F.greatest(sum((u * u for u in unit[1:]), unit[0] * unit[0]), F.lit(1e-12))
    signs = _with(apart, spread).groupBy("grp").agg(*(F.avg(unit[i] * unit[j] / length).alias(f"u{i}{j}") for i, j in _PAIRS))
    signs = base.join(signs, "grp").select("grp", "all", F.lit(STARTS[2]).alias("start"), *(f"m{i}" for i in range(3)), *((F.col(f"u{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}") * 3).alias(f"c{i}{j}") for i, j in _PAIRS))
    return median.unionByName(moments).unionByName(signs)


def mcd(rows: DataFrame) -> DataFrame:
    """Estimates (grp, n_group, m0.., c00..) for rows of grp, x0, x1, x2."""
    now = materialize(_starts(rows).withColumn("det", F.lit(float("inf"))), "estimates")
    done = None
    for step in range(STEPS):
        classes = _with(rows, now).withColumn("class", _class(_distance())).groupBy("grp", "start", "class").agg(F.first("all").alias("all"), F.first("det").alias("last"), *_sums())
        upto = W.partitionBy("grp", "start").orderBy("class").rowsBetween(W.unboundedPreceding, -1)
        part = (F.ceil(F.col("all") * SUBSET) - F.coalesce(F.sum("n").over(upto), F.lit(0.0))) / F.col("n")
        share = F.least(part, F.lit(1.0))
        kept = classes.withColumn("share", share).where("share > 0")
        total = kept.groupBy("grp", "start").agg(F.first("all").alias("all"), F.first("last").alias("last"), *(F.sum(F.col(c) * F.col("share")).alias(c) for c in ("n", *(f"s{i}" for i in range(3)), *(f"q{i}{j}" for i, j in _PAIRS))))
        new = _moments(total, "grp", "start", "all", "last").withColumn("det", _matrix()[1])
        new = materialize(new, "estimates")
        # A start stays while its determinant falls.
        falls = F.col("det") < F.col("last") * (1 - 1e-6)
        over = new if step == STEPS - 1 else new.where(~falls)
        done = over if done is None else done.unionByName(over)
        now = new.where(falls).drop("last")
        if now.isEmpty():
            break
    order = F.struct("det", "start")
    best = materialize(done.groupBy("grp").agg(F.min_by(F.struct("all", *_EST), order).alias("e")).select("grp", "e.*"), "estimates")
    # Consistency: the median distance is that of the normal distribution.
    classes = _with(rows, best).groupBy("grp", _class(_distance()).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.first("all").alias("all"))
    nearer = F.coalesce(F.sum("n").over(W.partitionBy("grp").orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    middle = classes.withColumn("nearer", nearer).where("nearer * 2 < all").groupBy("grp").agg(F.max("class").alias("class"))
    scale = F.greatest(F.expm1((F.col("class") + 0.5) / 200) / MEDIAN, F.lit(1.0))
    return materialize(best.join(middle, "grp").select("grp", F.col("all").alias("n_group"), *(f"m{i}" for i in range(3)), *((F.col(f"c{i}{j}") * scale).alias(f"c{i}{j}") for i, j in _PAIRS)), "estimates")


def _drawn(own: DataFrame, to: DataFrame | None, weight: Column, key: str) -> DataFrame:
    """Estimates ``own`` (key, parent, n_group, ..), weighted against those of their parent (unit variances without ``to``)."""
    if to is None:
        unit = {**{f"m{i}": F.col(f"m{i}") for i in range(3)}, **{f"c{i}{j}": F.lit(1.0 if i == j else 0.0) for i, j in _PAIRS}}
        return own.select(key, "n_group", *((F.col(c) * weight + unit[c] * (1 - weight)).alias(c) for c in _EST))
    parent = to.select(F.col(to.columns[0]).alias("parent"), *(F.col(c).alias(f"p{c}") for c in _EST))
    return own.join(parent, "parent").select(key, "n_group", *((F.col(c) * weight + F.col(f"p{c}") * (1 - weight)).alias(c) for c in _EST))


def estimates(good: DataFrame) -> DataFrame:
    """Estimates (grp, ..) of each language and source for rows of lang, source, x0, x1, x2."""
    cell, lang = F.concat_ws("\n", F.lit("cell"), "lang", "source"), F.concat_ws("\n", F.lit("lang"), "lang")
    once = good.select(F.array(F.lit("all"), lang, cell).alias("of"), *_X).distinct()
    rows = materialize(once.select(F.explode("of").alias("grp"), *_X).distinct(), "vectors")
    found = mcd(rows)
    of = materialize(good.select(lang.alias("lang_grp"), cell.alias("cell_grp")).distinct(), "groups")
    n = F.col("n_group")
    every = _drawn(found.where("grp = 'all'"), None, 1 - F.exp(-n / 20), "grp")
    langs = _drawn(found.join(of.select(F.col("lang_grp").alias("grp")).distinct(), "grp").withColumn("parent", F.lit("all")), every, n / (n + SHRINK), "grp")
    langs = materialize(langs, "languages")
    return _drawn(found.join(of.select(F.col("cell_grp").alias("grp"), F.col("lang_grp").alias("parent")), "grp"), langs, n / (n + SHRINK), "grp")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Statistics of each document, base_failed, distance (squared) and kept."""
    label = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.replace(F.col(c).cast("string"), F.lit("\n"), F.lit(" "))))
    stats = docs.select(F.col(id_col).alias("doc_id"), label(lang_col).alias("lang"), label(source_col).alias("source"), *(c.alias(n) for n, c in statistics(F.col(text_col).cast("string")).items()))
    rows = stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = materialize(rows.select("*", *(F.round(c, 6).alias(name) for c, name in zip(vector(), _X))), "statistics")
    good = rows.where("not base_failed")
    judged = _with(rows.withColumn("grp", F.concat_ws("\n", F.lit("cell"), "lang", "source")), materialize(estimates(good), "estimates"), "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.round(_distance(), 6)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
