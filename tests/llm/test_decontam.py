"""op3 against all pairs: many sizes of items, damaged passages, long texts, hot passages, edge cases."""

import random
from collections import Counter

import pytest

from graphloom.llm import decontam


def shingles(t, k=5):
    w = (t or "").lower().encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(r.choice([1, 4, 5, 9, 16, 17, 20, 40, 90, 200])))) for i in range(80)]
    items += [(100, None), (101, ""), (None, items[3][1]), (7, items[7][1])]
    docs = []
    for i in range(150):
        w = [word() for _ in range(r.choice([0, 3, 30, 300]))]
        for _ in range(r.choice([0, 1, 2])):
            part = (items[r.randrange(80)][1]).split()
            if r.random() < 0.4 and len(part) > 16:
                part[r.randrange(len(part))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i if i % 11 else None, " ".join(w)))
    hot = items[30][1] + " " + items[31][1]
    docs += [(1000 + i, f"x{i} {hot} y{i}") for i in range(120)] + [(3, None), (3, ""), docs[5], docs[5]]
    long = [word() for _ in range(260_000)]
    long[150_000:150_000] = items[12][1].split()
    docs.append((5000, " ".join(long)))
    schema = "doc_id long, text string, x long, y string, row long, hits string"
    return spark.createDataFrame([(*d, 1, "y", 2, "h") for d in docs], schema).repartition(5), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_pairs_are_those_of_all_pairs(tables):
    frame, items, docs, plain = tables
    sets = [(i, shingles(t)) for i, t in plain]
    want = Counter()
    for d, t in docs:
        s = shingles(t)
        for i, x in sets:
            if x and 100 * len(s & x) >= 75 * len(x):
                want[d, i, len(s & x), len(x)] += 1
    got = Counter(tuple(r) for r in decontam.contained_items(frame, items).collect())
    assert got == want and len(want) > 100


def test_rows_that_contain_an_item_go(tables):
    frame, items, docs, plain = tables
    sets = [x for x in (shingles(t) for _, t in plain) if x]
    bad = lambda t: any(100 * len(shingles(t) & x) >= 75 * len(x) for x in sets)
    kept = decontam.decontaminate(frame, items)
    assert kept.columns == frame.columns and kept.schema == frame.schema
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(d for d in docs if not bad(d[1]))


def test_empty_tables(tables):
    frame, items, docs, _ = tables
    assert decontam.contained_items(frame.limit(0), items).count() == 0
    assert decontam.contained_items(frame, items.limit(0)).count() == 0
    assert decontam.decontaminate(frame, items.limit(0)).count() == len(docs)
    assert decontam.decontaminate(frame.limit(0), items).count() == 0
