"""op9: the fit against plain statements of its loss, held-out labels, bounded samples, edge cases."""

import random

import numpy as np
import pytest

from graphloom.llm import toxicity
from graphloom.llm.common import materialize


def sparse(x):
    row, column = np.nonzero(x)
    return toxicity.Sparse(len(x), row, column, x[row, column])


def plain_loss(x, grade, w, th, ridge):
    total = ridge / 2 * sum(v * v for v in w)
    for v, g in zip(x, grade):
        below = [0.0, *(1 / (1 + np.exp(-(t - v @ w))) for t in th), 1.0]
        total -= np.log(below[g + 1] - below[g])
    return total


def test_fit_is_the_least_loss():
    r = np.random.default_rng(1)
    x = (r.random((400, 6)) < 0.4) * r.random((400, 6))
    true = np.array([3.0, -2.0, 1.0, 0.0, 0.5, 0.0])
    z = x @ true + r.logistic(size=400)
    grade = np.searchsorted([0.3, 1.2, 2.5], z)
    w, th = toxicity.fit_ordinal(sparse(x), 6, grade, 4, 0.5)
    assert (np.diff(th) > 0).all()
    best = plain_loss(x, grade, w, th, 0.5)
    for _ in range(60):
        step = r.normal(size=9)
        for size in (0.02, 0.3):
            if (np.diff(th + size * step[6:]) <= 0).any():
                continue  # not a model
            assert plain_loss(x, grade, w + size * step[:6], th + size * step[6:], 0.5) > best - 0.01
    for i in range(9):
        e = np.zeros(9)
        e[i] = 1e-4
        slope = (plain_loss(x, grade, w + e[:6], th + e[6:], 0.5) - plain_loss(x, grade, w - e[:6], th - e[6:], 0.5)) / 2e-4
        assert abs(slope) < 0.05
    p = toxicity.grade_probabilities(x @ w, th)
    assert p.sum(axis=1) == pytest.approx(1) and (p > 0).all()


def test_association_is_the_likelihood_ratio():
    a, b = 40, 160
    for t, c in ((0, 0), (10, 2), (40, 160), (0, 90), (6, 0), (3, 12)):
        table = np.array([[t, a - t], [c, b - c]], float)
        want = sum(2 * o * np.log(o / e) for o, e in zip(table.ravel(), np.outer(table.sum(1), table.sum(0)).ravel() / 200) if o > 0)
        assert toxicity.associated(np.array([t]), np.array([c]), a, b)[0] == (np.sqrt(want) >= toxicity.ROOT_LEAST)


def test_grades_are_thirds_of_margins_of_other_folds():
    r = np.random.default_rng(2)
    toxic = np.arange(300) % 3 == 0
    x = np.stack([toxic * r.integers(1, 9, 300), r.random(300)], axis=1).astype(float)
    grade = toxicity.severity_grades(sparse(x), 2, toxic, np.arange(300) % 7 % toxicity.FOLDS)
    assert (grade[~toxic] == 0).all()
    sizes = np.bincount(grade[toxic], minlength=4)[1:]
    assert sizes.sum() == 100 and sizes.min() >= 20
    assert x[grade == 3, 0].mean() > x[grade == 2, 0].mean() > x[grade == 1, 0].mean()
    same = np.where(toxic[:, None], [1.0, 0.0], [0.0, 1.0])
    assert len(set(toxicity.severity_grades(sparse(same), 2, toxic, np.arange(300) % 3)[toxic])) <= 3


def test_labels_of_documents_left_out_of_the_fit(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    marks = read("labels").where("toxic is not null").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")
    out = materialize(toxicity.severities(read("documents"), marks.where("doc_id % 2 = 0")), "scores")
    held = out.drop("toxic").join(marks.where("doc_id % 2 = 1"), "doc_id").toPandas()
    said, toxic = held.p_toxic > 0.5, held.toxic > 0
    # Some labelled documents hold no toxic word at all.
    assert toxic.sum() > 150 and said[toxic].mean() > 0.9 and said[~toxic].mean() < 0.005
    grades = out.where("toxic").groupBy("grade").count().toPandas().set_index("grade")["count"]
    assert set(grades.index) <= {0, 1, 2, 3} and grades.get(1, 0) > 50 and grades.get(3, 0) > 50


def test_sample_bounds_rows_of_one_id(spark, monkeypatch):
    r = random.Random(3)
    text = lambda t: " ".join(r.choice(["calm", "tree", "road", "sun", *(["vile", "nasty"] if t else [])]) for _ in range(30))
    rows = [(1, text(1), "a", 1) for _ in range(400)] + [(2, text(0), "a", 1) for _ in range(400)] + [(2, "same calm", "b", 2)] * 300 + [(None, text(1), None, None), (3, None, "c", 3), (4, "sun " * 200_000, "c", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sum string, size long").repartition(5)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 250)
    drawn = toxicity._labelled(frame, labels, "doc_id", "text")
    assert drawn.count() == 250 and drawn.where("text = 'same calm'").count() <= 1
    monkeypatch.setattr(toxicity, "SAMPLE", 20_000)
    out = toxicity.severities(frame, labels).collect()
    assert len(out) == len(rows)
    assert all(x.toxic for x in out if x.doc_id in (1, None)) and not any(x.toxic for x in out if x.doc_id in (2, 3, 4))
    kept = toxicity.reject_toxic(frame, labels)
    assert kept.columns == frame.columns and kept.count() == 702
    assert toxicity.reject_toxic(frame.limit(0), labels).count() == 0
    assert toxicity.reject_toxic(frame, labels.limit(0)).count() == len(rows)
