"""op8: dealt shingles, long texts, clashing names."""

import random

import pytest

from graphloom.llm import jaccard


def sets_of(texts, k=5):
    out = []
    for t in texts:
        w = (t or "").lower().encode().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def classes(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def near_copies(seed):
    """Chains of copies that move away from their original, so that many link with few others only."""
    r = random.Random(seed)
    out = []
    for g in range(3):
        base = [f"w{g}_{i}" for i in range(80)]
        for i in range(70):
            w = list(base) if i % 3 else list(out[-1].split()) if out and i else list(base)
            for _ in range(r.choice([0, 1, 2, 3])):
                w[r.randrange(len(w))] = f"x{g}_{i}_{r.random()}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("each", [3, 25])
def test_dealt_shingles_lose_no_link(spark, monkeypatch, each):
    monkeypatch.setattr(jaccard, "RUN_EACH", each)
    monkeypatch.setattr(jaccard, "RUN", 6)
    texts = near_copies(each)
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n string, gid long, token long")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(frame).collect()}
    want = classes(sets_of(texts))
    assert [got[i] for i in range(len(texts))] == want
    kept = jaccard.representatives(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_dealt_shingles_meet_in_parts(monkeypatch):
    """Entries of a shingle in all documents go to many partitions."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "RUN_EACH", 50)
    texts = [f"a b c d e f g h i j k l m{i % 7}" for i in range(600)]
    sets = jaccard.shingle_sets([t.encode() for t in texts], 5)
    counts = np.bincount((np.concatenate(sets) >> np.uint64(64 - jaccard.BITS)).astype(np.int64), minlength=1 << jaccard.BITS)

    class Sent:
        value = np.round(np.log2(counts.astype(float) + 1) * 4).astype(np.uint8)

    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([jaccard.cs.deflate(t.encode()) for t in texts], pa.binary())], names=["gid", "blob"])
    rows = pa.concat_tables(pa.Table.from_batches([b]) for b in jaccard._prefixes(5, 75, Sent, 0.0, 64)([batch]))
    most = {}
    for pid in set(rows.column("pid").to_pylist()):
        token, gid, _, _, _, _ = jaccard._entries(rows.filter(pa.compute.equal(rows.column("pid"), pid)))
        most[pid] = max(np.unique(token, return_counts=True)[1])
    assert max(most.values()) < 200


def test_a_very_long_text(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(100_000)}" for _ in range(300_000)]
    near = list(words)
    for _ in range(2_000):
        near[r.randrange(len(near))] = "changed"
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(words[:200_000])), (4, "short text")]
    out = {x.doc_id: x.component_id for x in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 1, 3: 1, 2: 2, 4: 4}
