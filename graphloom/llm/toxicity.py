"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are hashed terms (2^20 dims): the words of a text in lower case, and their prefixes
of 4 to 8 letters; the value is log(1 + occurrences). Those are used whose presence and the toxic label
depend on each other, either way: the root of the likelihood ratio is at least ``ROOT_LEAST`` (by chance less
than one of all dims), one rule at any number of labels; there is no cap on their number.

Labels are 0 or 1; no table names a severity. Grades are 0 for documents that are not labelled toxic, and 1, 2
or 3 for toxic ones by the thirds of their margins, each given by a logistic model that was fitted without the
document's own fold (of ``FOLDS``): how plainly what is toxic elsewhere shows in it. The model is
P(grade <= k) = sigmoid(threshold k - w x), with one weight vector for all thresholds, fitted by L-BFGS on sparse
rows; it outputs the expected grade and rejects a document if P(grade >= 1) > 1/2.

The fit uses at most ``SAMPLE`` labelled rows, those with the smallest checksums of id and text (equal rows
once); statistics of terms are summed over them in counters of fixed size. Scoring is one pass over all
whole texts without a shuffle.

Defined results: null and empty texts have no features and get the model's base rate; a very long text is read whole,
and holds as many counters as it has features; labels that are null, or of ids not in documents, are not used; of
several labels of an id the largest counts; all rows of a labelled id are labelled; without both labels no
document is rejected and severities are 0; null and repeated ids and repeated rows are scored as any others; empty
tables give an empty result; other columns pass, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunkstore as cs

DIMS, PREFIXES = 1 << 20, (4, 5, 6, 7, 8)
SAMPLE, ROOT_LEAST = 20_000, 5.0
TOXIC_GRADES, FOLDS = 3, 3
_CACHE = 300_000


def _dims(word: str) -> tuple[int, ...]:
    terms = {word, *(word[:k] for k in PREFIXES if k < len(word))}
    return tuple({zlib.crc32(t.encode()) % DIMS for t in terms})


def _counts(text: str | None, known: dict[str, tuple[int, ...]], of) -> dict[int, int]:
    """Occurrences of each feature; known keeps what words give."""
    out: dict[int, int] = {}
    if not text:
        return out
    for word in text.lower().split():
        hit = known.get(word)
        if hit is None:
            if len(known) >= _CACHE:
                known.clear()
            hit = known[word] = of(word)
        for d in hit:
            out[d] = out.get(d, 0) + 1
    return out


@dataclass
class Sparse:
    """A matrix of n rows by its entries."""

    n: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def turned_times(self, r: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], d)

    def only(self, rows: np.ndarray) -> Sparse:
        number = np.cumsum(rows) - 1
        kept = rows[self.row]
        return Sparse(int(rows.sum()), number[self.row[kept]], self.column[kept], self.value[kept])


@dataclass
class Model:
    dims: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def grade_probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    below = _sigmoid(thresholds[None, :] - score[:, None])
    return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def minimum(f, x: np.ndarray, rounds: int = 300, memory: int = 8, close: float = 1e-6) -> np.ndarray:
    """Where f (value and gradient) is least: limited-memory quasi-Newton steps with a halving line search."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < close:
            break
        step, used = -g, []
        for s, y in reversed(past):
            a = s @ step / (s @ y)
            step = step - a * y
            used.append(a)
        if past:
            s, y = past[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used)):
            step = step + (a - y @ step / (s @ y)) * s
        t = 1.0 if past else min(1.0, 1 / np.abs(g).sum())
        while t > 1e-12:
            new, h = f(x + t * step)
            if new <= value + 1e-4 * t * (g @ step):
                break
            t /= 2
        else:
            break
        s, y = t * step, h - g
        x, value, g = x + s, new, h
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
    return x


def fit_ordinal(x: Sparse, d: int, grade: np.ndarray, grades: int, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds with the least log loss and ridge / 2 times the squared weights."""
    n = x.n
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 1e-4, 1 - 1e-4)
    first = np.log(share / (1 - share))
    row = np.arange(n)

    def thresholds(free):
        # The first one, and the logs of the steps between them.
        return free[d] + np.concatenate([[0.0], np.cumsum(np.exp(free[d + 1 :]))])

    def loss(free):
        w, s = free[:d], x.times(free[:d])
        edge = np.concatenate([np.full((n, 1), -np.inf), np.broadcast_to(thresholds(free), (n, grades - 1)), np.full((n, 1), np.inf)], axis=1)
        hi, lo = edge[row, grade + 1] - s, edge[row, grade] - s
        a, b = _sigmoid(hi), _sigmoid(lo)
        p = np.maximum(a - b, 1e-300)
        dhi, dlo = a * (1 - a) / p, b * (1 - b) / p
        dhi[np.isinf(hi)], dlo[np.isinf(lo)] = 0, 0
        gth = np.array([-dhi[grade == k].sum() + dlo[grade == k + 1].sum() for k in range(grades - 1)])
        tail = np.cumsum(gth[::-1])[::-1]
        # Steps of grades without documents are held by a weak pull.
        steps = free[d + 1 :]
        g = np.concatenate([x.turned_times(dhi - dlo, d) + ridge * w, tail[:1], tail[1:] * np.exp(steps) + 1e-3 * steps])
        return (-np.log(p).sum() + ridge / 2 * (w @ w) + 5e-4 * (steps @ steps)) / n, g / n

    free = minimum(loss, np.concatenate([np.zeros(d), first[:1], np.log(np.maximum(np.diff(first), 1e-2))]))
    return free[:d], thresholds(free)


def severity_grades(x: Sparse, d: int, toxic: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic; 1, 2, .. by the quantiles of the toxic rows' out-of-fold margins."""
    margin = np.zeros(x.n)
    for k in range(FOLDS):
        rest = fold != k
        if len(np.unique(toxic[rest])) == 2:
            w, th = fit_ordinal(x.only(rest), d, toxic[rest].astype(np.int64), 2)
            margin[~rest] = x.only(~rest).times(w) - th[0]
    edges = np.quantile(margin[toxic], np.arange(1, TOXIC_GRADES) / TOXIC_GRADES)
    return np.where(toxic, 1 + np.searchsorted(edges, margin, side="left"), 0)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, toxic, size and sum of SAMPLE labelled rows at most."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    place = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # SAMPLE rows of an id and a label: bounded, so sent to all tasks.
    drawn = marks.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(place, "doc_id").limit(SAMPLE)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = rows.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic", F.length(text).alias("size"), F.crc32(text).alias("sum"))
    # An id may have any number of rows: they are drawn as well, by their keys; equal ones once.
    key = ["doc_id", "size", "sum"]
    chosen = rows.select(*key).distinct().orderBy(place, *key).limit(SAMPLE)
    return rows.join(F.broadcast(chosen), key, "left_semi").dropDuplicates(key)


def _association(batches):
    total = np.zeros((2, DIMS), np.uint32)
    known: dict = {}
    for batch in batches:
        for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            total[int(toxic > 0), np.fromiter(_counts(text, known, _dims), np.int64)] += 1
    if known:
        for i, part in enumerate(np.split(total, 16, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([cs.deflate(part.tobytes())], pa.binary())], names=["block", "data"])


def _choose(a: int, b: int):
    def run(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(cs.inflate(x.as_py()), np.uint32).reshape(2, -1).astype(np.int64) for x in group.column("data"))
        base = group.column("block")[0].as_py() * (DIMS // 16)
        at = np.flatnonzero(total.any(axis=0))
        return pa.table({"dim": pa.array(base + at[associated(total[1, at], total[0, at], a, b)], pa.int64())})

    return run


def associated(toxic: np.ndarray, clean: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether terms in so many of a toxic and of b clean documents depend on the label (log-likelihood ratio)."""
    n, total = a + b, 0.0
    for seen, of in ((toxic, a), (clean, b)):
        for part, whole in ((seen, toxic + clean), (of - seen, n - toxic - clean)):
            with np.errstate(divide="ignore", invalid="ignore"):
                total = total + np.where(part > 0, part * np.log(part * (n / of) / np.maximum(whole, 1)), 0.0)
    return np.sqrt(np.maximum(2 * total, 0)) >= ROOT_LEAST


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    from .common import materialize

    rows = materialize(_labelled(docs, labels, id_col, text_col), "labelled", "zstd")
    size = {bool(r.t): r.n for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = size.get(True, 0), size.get(False, 0)
    if not a or not b:
        return None
    counts = rows.select("doc_id", "text", "toxic").mapInArrow(_association, "block int, data binary").groupBy("block").applyInArrow(_choose(a, b), "dim long").toArrow()
    if not counts.num_rows:
        return None
    dims = np.sort(counts.column("dim").to_numpy())
    number = {int(d): i for i, d in enumerate(dims)}

    def vectors(batches):
        known: dict = {}
        of = lambda w: tuple(number[d] for d in _dims(w) if d in number)
        for batch in batches:
            found = [_counts(t, known, of) for t in batch.column(1).to_pylist()]
            fold = pa.array([zlib.crc32(b"fold" + str(x).encode()) % FOLDS for x in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *(batch.column(i).cast(pa.int64()) for i in (2, 3, 4)), fold, pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["id", "toxic", "size", "sum", "fold", "at", "times"])

    # SAMPLE rows of a few features each; in an order of their own, so that the fit does not depend on the tasks'.
    got = rows.select("doc_id", "text", "toxic", "size", "sum").mapInArrow(vectors, "id string, toxic long, size long, sum long, fold int, at array<int>, times array<int>").toArrow().sort_by([("id", "ascending"), ("size", "ascending"), ("sum", "ascending")])
    at = got.column("at").combine_chunks()
    x = Sparse(got.num_rows, np.repeat(np.arange(got.num_rows), at.value_lengths().to_numpy()), at.flatten().to_numpy(), np.log1p(got.column("times").combine_chunks().flatten().to_numpy()))
    toxic = got.column("toxic").to_numpy() > 0
    grade = severity_grades(x, len(dims), toxic, got.column("fold").to_numpy())
    weights, thresholds = fit_ordinal(x, len(dims), grade, TOXIC_GRADES + 1)
    return Model(dims, weights, thresholds)


SCORES = "severity double, grade int, p_toxic double, toxic boolean"


def _scorer(model: Model | None):
    number = {} if model is None else {int(d): i for i, d in enumerate(model.dims)}

    def score(texts: list, known: dict):
        if model is None:
            return np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.zeros(len(texts))
        of = lambda w: tuple(number[d] for d in _dims(w) if d in number)
        s = np.zeros(len(texts))
        for i, t in enumerate(texts):
            found = _counts(t, known, of)
            if found:
                s[i] = model.weights[list(found)] @ np.log1p(list(found.values()))
        p = grade_probabilities(s, model.thresholds)
        return p @ np.arange(p.shape[1]), p.argmax(axis=1).astype(np.int32), 1 - p[:, 0]

    return score


def severities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected severity, likeliest grade, P(grade >= 1) and the verdict, for each document."""
    score = _scorer(fit(docs, labels, id_col, text_col))

    def run(batches):
        known: dict = {}
        for batch in batches:
            e, g, p = score(batch.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(e, 6)), pa.array(g), pa.array(np.round(p, 6)), pa.array(p > 0.5)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + SCORES)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are rejected; all columns as they were."""
    score = _scorer(fit(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        known: dict = {}
        for batch in batches:
            _, _, p = score(batch.column(at).to_pylist(), known)
            yield batch.filter(pa.array(p <= 0.5))

    return docs.mapInArrow(run, docs.schema)
