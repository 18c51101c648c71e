"""op2 against a plain model without a grid, op6 against plain raking."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import lm, mixing


def plain_scores(rows):
    """Scores of (id, text) by dictionaries: exact estimates, no grid, no chunks."""
    token = lambda t: [*(t or "").lower().split(), None]
    counts = [[Counter(), Counter(), Counter()] for _ in range(2)]  # by part: tokens, contexts, pairs
    for doc, text in rows:
        if (f := lm.fold(doc)) != lm.HELD_OUT:
            one, ctx, two = counts[f == lm.WEIGHTS_FROM]
            for a, b in zip(["<s>", *token(text)], token(text)):
                one[b] += 1
                ctx[a] += 1
                two[a, b] += 1
    bucket = lambda c: int(np.ceil(np.log2(c + 1)))
    one, ctx, two = counts[0]
    n, v = sum(one.values()), len(one)
    events = defaultdict(list)
    for doc, text in rows:
        if lm.fold(doc) == lm.WEIGHTS_FROM:
            for a, b in zip(["<s>", *token(text)], token(text)):
                # As a context, a word counts as often as it occurs, the end token included.
                c = one[a] if a != "<s>" else ctx[a]
                events[bucket(c)].append((two[a, b] / c if c else 0.0, one[b] / n, 1 / (v + 1)))
    weights = {}
    for k, x in events.items():
        x, w = np.array(x), np.array([0.4, 0.4, 0.2])
        for _ in range(60):
            share = x * w
            w = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + [0.1, 0.1, 0.01]
            w = w / w.sum()
        weights[k] = w
    one, ctx, two = (a + b for a, b in zip(*counts))
    n, v = sum(one.values()), len(one)
    out = []
    for doc, text in rows:
        total = 0.0
        for a, b in zip(["<s>", *token(text)], token(text)):
            c = one[a] if a != "<s>" else ctx[a]
            # A bucket without events has seen its pulls only.
            w = weights.get(bucket(c), np.array([0.1, 0.1, 0.01]) / 0.21)
            p = w[1] * one[b] / n + w[2] / (v + 1)
            total += np.log10(p + w[0] * two[a, b] / c if c else p / (w[1] + w[2]))
        out.append(total)
    return out


def test_scores_are_those_of_the_plain_model(spark):
    r = random.Random(5)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(5000)]
    rows = [(i if i % 40 else None, " ".join(w for _ in range(r.choice([0, 5, 40, 200])) for w in r.choice([("the", r.choice(vocabulary)), (r.choice(vocabulary),)]))) for i in range(400)]
    rows += [(7, None), (9, rows[3][1]), (9, rows[3][1])]
    out = Counter()
    for x in lm.score_documents(spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, score string, chunk long")).collect():
        out[x.doc_id, x.n_tokens, round(x.score / x.n_tokens, 2)] += 1
    want = plain_scores(rows)
    assert sum(out.values()) == len(rows)
    lengths = [len((t or "").split()) + 1 for _, t in rows]
    for (doc, _), score, n in zip(rows, want, lengths):
        near = [k for k in out if k[:2] == (doc, n) and abs(k[2] - score / n) < 0.02]
        assert near, (doc, n, score / n, [k for k in out if k[:2] == (doc, n)])


def test_the_model_tells_more_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.score_documents(docs).where("held_out").toPandas()
    assert out.score.sum() / out.n_tokens.sum() > out.base_score.sum() / out.n_tokens.sum() + 0.4


def test_raking_agrees_with_plain_fitting(spark):
    r = np.random.default_rng(6)
    axes = [("s0", "s1", "s2"), ("en", "de"), ("a", "b", "c")]
    table = r.integers(500, 5000, size=(3, 2, 3)).astype(float)
    table[2, 1, 0] = 0
    cells = [(f"={s}", f"={g}", f"={t}", int(table[i, j, k])) for i, s in enumerate(axes[0]) for j, g in enumerate(axes[1]) for k, t in enumerate(axes[2])]
    given = {"source": {"s0": 0.4, "s1": 0.35, "s2": 0.25}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"a": 0.3, "b": 0.3, "c": 0.4}}
    want = table * 0.2
    shares = [np.array([given[a][c] for c in names]) for a, names in zip(("source", "lang", "topic"), axes)]
    for _ in range(300):
        for axis, share in enumerate(shares):
            now = want.sum(axis=tuple(i for i in range(3) if i != axis))
            shape = [1, 1, 1]
            shape[axis] = -1
            want = want * (share * 0.2 * table.sum() / now).reshape(shape)
    assert (want <= table).all()  # no cell is at its cap
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    got = {(x.source, x.lang, x.topic): x.kept for x in mixing.rake(frame, given, tolerance=1e-8, keep=0.2).collect()}
    for i, s in enumerate(axes[0]):
        for j, g in enumerate(axes[1]):
            for k, t in enumerate(axes[2]):
                if table[i, j, k]:
                    assert got[f"={s}", f"={g}", f"={t}"] == pytest.approx(want[i, j, k], rel=1e-4)


def test_targets_that_cannot_be_met_warn(spark):
    cells = spark.createDataFrame([("=a", "=x", "=t", 100), ("=b", "=y", "=t", 100)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="marginals still differ"):
        mixing.rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, rounds=2, keep=0.1)


def test_all_three_marginals_hold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.weigh(docs).toPandas()
    cells = out.groupby(["source", "lang", "topic"], dropna=False).agg(tokens=("n_tokens", "sum"), p=("probability", "first")).reset_index()
    kept = cells.p * cells.tokens
    assert kept.sum() == pytest.approx(cells.tokens.sum() * mixing.KEEP, rel=1e-3)
    for axis in ("source", "lang", "topic"):
        tokens = cells.groupby(axis).tokens.sum()
        target = tokens**0.7 / (tokens**0.7).sum()
        share = kept.groupby(cells[axis]).sum() / kept.sum()
        full = kept.groupby(cells[axis]).sum() >= tokens * 0.999
        assert (share[~full] / target[~full]).std() < 2e-3
