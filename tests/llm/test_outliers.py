"""op7: estimates against brute force, verdicts against constant scales, junk and edge cases."""

import itertools
import random
import re

import numpy as np
import pytest

from graphloom.llm import rules

DOC = "doc_id long, text string, lang string, source string"


def brute_mcd(x, h):
    best = min((np.linalg.det(np.cov(x[list(i)].T, bias=True)), i) for i in itertools.combinations(range(len(x)), h))
    part = x[list(best[1])]
    return best[0], part.mean(axis=0), np.cov(part.T, bias=True)


def test_estimates_are_those_of_least_determinant(spark):
    r = np.random.default_rng(3)
    groups = {}
    for g in range(4):
        mix = r.normal(size=(3, 3))
        x = r.normal(size=(16, 3)) @ mix + r.normal(size=3)
        x[:4] += 25 * (g + 1)  # as many as the subset leaves out
        groups[f"g{g}"] = x.round(6)
    rows = [(k, *map(float, v)) for k, x in groups.items() for v in x]
    out = {e.grp: e for e in rules.mcd(spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double")).collect()}
    for k, x in groups.items():
        _, mean, cov = brute_mcd(x, 12)
        e = out[k]
        assert e.n_group == 16
        assert [e.m0, e.m1, e.m2] == pytest.approx(mean, abs=1e-6)
        got = np.array([[e.c00, e.c01, e.c02], [e.c01, e.c11, e.c12], [e.c02, e.c12, e.c22]])
        scale = got[0, 0] / cov[0, 0]
        assert scale >= 1 and np.allclose(got, scale * cov, rtol=1e-4, atol=1e-6)


@pytest.fixture(scope="module")
def judged(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    return rules.quality(read("documents")).join(read("documents").select("doc_id", "lang", "source", "text"), "doc_id").toPandas()


def test_verdicts_are_not_those_of_constant_scales(judged):
    """No one scale of all groups about their medians gives the verdicts that the estimates give."""
    good = judged[~judged.base_failed]
    n = good.n_words + rules.PRIOR
    marks = good.text.map(lambda t: len(re.findall(r"[^\w\s]|_", t)))
    x = np.stack([np.log((good.word_chars + 5 * rules.PRIOR) / n), np.log((marks + 0.14 * rules.PRIOR) / n)], axis=1)
    centred = x - good.assign(a=x[:, 0], b=x[:, 1]).groupby(["lang", "source"])[["a", "b"]].transform("median").to_numpy()
    for scale in ((0.01, 1.0), (0.1, 1.0), (1.0, 1.0)):
        assert (((centred**2 / scale).sum(axis=1) <= rules.CUT) != good.kept).sum() > 100
    spread = good.groupby(["lang", "source"]).distance.median()
    assert spread.between(1.5, 3.5).all()  # that of chi-square: 2.37


def test_counts(judged):
    part = judged.head(300)
    for row in part.itertuples():
        lines = [x for x in row.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", row.text))
        assert row.n_dup_lines == len(lines) - len(set(lines))


def test_few_documents_copies_and_names(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.choice([3, 4, 5, 6, 7]))) + r.choice(["", "", "", "", "", "", ","]) for _ in range(n))
    schema = DOC + ", x0 double, grp string, n_words long"
    few = [(i, prose(60), "en", "s", 1.0, "g", 7) for i in range(4)]
    out = rules.quality(spark.createDataFrame(few, schema)).collect()
    assert len(out) == 4 and all(x.kept for x in out)
    # Copies that fill a group do not make its other documents outliers; nor does a text's length.
    copy = prose(80)
    rows = [(i, copy, "en", "s") for i in range(300)] + [(1000 + i, prose(r.choice([12, 40, 120, 400])), "en", "s") for i in range(60)]
    rows += [(2000, prose(30_000), "en", "s"), (None, None, None, None), (2001, "", "en", None), (2001, "", "en", None)]
    rows += [(3000 + i, prose(50).replace(" ", "*** "), "en", "s") for i in range(3)]
    out = rules.quality(spark.createDataFrame(rows, DOC)).collect()
    assert len(out) == len(rows)
    assert all(x.kept for x in out if x.doc_id is not None and x.doc_id <= 2000)
    assert not any(x.kept for x in out if x.doc_id is None or x.doc_id > 2000)
