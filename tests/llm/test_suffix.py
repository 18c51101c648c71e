"""op10: groups have all occurrences, hot anchors are divided, long texts and edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import chunkstore, suffix, textkernel


def corpus():
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passages = [noise(n) for n in (60, 75, 150, 400)]
    out = []
    for _ in range(40):
        parts = [noise(r.choice([0, 5, 50, 300]))]
        for _ in range(r.choice([0, 1, 2, 3])):
            parts += [r.choice(passages), noise(r.choice([0, 1, 30]))]
        out.append("".join(parts))
    line = noise(70)
    out += [noise(90) + line + noise(90) for _ in range(60)]
    return [*out, out[0], out[1], None, "", "é" * 90, "é" * 45, "ab" * 100, passages[3] * 3]


def places(x, sub):
    at, out = x.find(sub), []
    while at >= 0:
        out.append(at)
        at = x.find(sub, at + 1)
    return out


@pytest.mark.parametrize("hot", [20_000, 5])
def test_groups_have_all_occurrences(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "STEP", 8)
    least, texts = 56, corpus()
    data = [(t or "").encode() for t in texts]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, data string, group long").repartition(3)
    groups = defaultdict(set)
    for row in suffix.maximal_repeats(frame, least).collect():
        groups[row.group, row.length].add((row.doc_id, row.start))
    assert groups
    covered = [np.zeros(len(x), bool) for x in data]
    for (_, n), at in groups.items():
        doc, start = min(at)
        sub = data[doc][start : start + n]
        assert len(sub) == n >= least and len(at) > 1
        want = {(i, p) for i, x in enumerate(data) for p in places(x, sub)}
        if hot > 1000:
            assert at == want
        else:  # a divided anchor may give pieces of one text to several groups
            assert at <= want
        for i, p in at:
            covered[i][p : p + n] = True
    windows = Counter(x[i : i + least] for x in data for i in range(len(x) - least + 1))
    for x, got in zip(data, covered):
        need = np.zeros(len(x), bool)
        for i in range(len(x) - least + 1):
            if windows[x[i : i + least]] > 1:
                need[i : i + least] = True
        assert (got == need).all()
    out = {r.doc_id: r for r in suffix.dedup_suffixes(frame, least).collect()}
    for i, (x, gone) in enumerate(zip(data, covered)):
        kept = bytes(b for b, g in zip(x, gone) if not g)
        assert (out[i].n_removed, out[i].kept_sha256) == (int(gone.sum()), hashlib.sha256(kept).hexdigest())


def test_no_task_has_all_of_a_hot_anchor(monkeypatch):
    """One line in all documents, with neighbours of their own: its stretches go to many partitions."""
    r = random.Random(12)
    noise = lambda n: bytes(r.choice(b"abcdefghij ") for _ in range(n))
    # A line with a gram that nearly all windows over it name.
    line = min((noise(70) for _ in range(3000)), key=lambda x: textkernel.grams(textkernel.byte_values(np.frombuffer(x, np.uint8)), suffix.ANCHOR).min())
    docs = [noise(250) + line + noise(250) for _ in range(400)]
    lens = np.array([len(x) for x in docs])
    chunk = chunkstore.Chunk(0, list(range(400)), lens, np.cumsum(lens + 1) - lens - 1, np.frombuffer(b"\n".join(docs), np.uint8))
    w = suffix._Windows(chunk, 200)
    keys, counts = np.unique(w.key, return_counts=True)
    most = {}
    for hot in (10, 20_000):
        back = {0: chunkstore.deflate(((counts >= 2).astype(np.uint8) + (counts > hot)).tobytes())}
        most[hot] = max(n for pid, _, n, _ in suffix._stretches(chunk, back, 200, 64) if pid >= 0)
    assert most[20_000] >= 390 and most[10] <= 130


def test_a_text_longer_than_blocks(spark):
    r = random.Random(13)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(3_000_000))
    rows = [(1, long), (2, "tail " + long[1_048_000:1_049_500]), (3, long[-300:])]
    out = {x.doc_id: x for x in suffix.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()}
    assert (out[1].n_removed, out[1].n_spans, out[2].n_removed, out[3].n_removed) == (1_800, 2, 1_500, 300)
