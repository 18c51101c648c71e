"""The pipeline against a composition of plain stages."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from graphloom.llm import mixing, toxicity

from .test_jaccard import classes, sets_of
from .test_sharding import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x long, shard int, _mix string"
FIXED = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(21)
    word = lambda: f"w{r.randrange(3000)}"
    rows = []
    for i in range(260):
        w = [word() for _ in range(r.choice([3, 40, 120, 250]))]
        if i % 9 == 0:
            w[::6] = ["vile" if k % 2 else "nasty" for k in range(len(w[::6]))]
        if i % 7 == 0 and rows:
            w = rows[r.randrange(len(rows))][1].split()
            if len(w) > 60:
                w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), ["en", "de", None][i % 3], f"s{i % 2}" if i % 5 else None))
    items = [" ".join(word() for _ in range(n)) for n in (8, 20, 60)]
    rows += [(1000 + i, f"{word()} {items[i % 3]} {' '.join(word() for _ in range(30))}", "en", "s0") for i in range(9)]
    rows += [(None, rows[1][1] + " more", "en", "s1"), (None, None, None, None), (2000, "", "de", "s1"), (2001, "one", "en", "s0"), rows[2], rows[2]]
    rows += [(3000, " ".join(word() for _ in range(150_000)), "en", "s1")]
    labels = [(i, int(i % 9 == 0 and i % 7 != 0)) for i in range(200) if i % 7]
    return rows, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows, items, labels = corpus()
    spark.createDataFrame([(*r, 0, 1, 2, "m") for r in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_the_pipeline_is_its_plain_stages(spark, folder):
    rows, items, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    verdicts = Counter((x.doc_id, x.text) for x in toxicity.reject_toxic(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), marks).collect())
    left = []
    for r in rows:
        if verdicts[r[:2]]:
            verdicts[r[:2]] -= 1
            left.append(r)
    assert 10 < len(rows) - len(left) < 60
    sets, best = sets_of([t for _, t, _, _ in left]), {}
    roots = classes(sets)
    key = lambda i: (left[i][0] is None, left[i][0] or 0)
    for i, root in enumerate(roots):
        if sets[i] and (root not in best or key(i) < key(best[root])):
            best[root] = i
    left = [left[i] for i in range(len(left)) if not sets[i] or i in best.values()]
    wanted = sets_of(items)
    left = [r for r, s in zip(left, sets_of([r[1] for r in left])) if not any(100 * len(s & x) >= 75 * len(x) for x in wanted)]
    frame = spark.createDataFrame([(*r, 0) for r in left], FIXED)
    kept = Counter((x.doc_id, x.text) for x in mixing.mix(frame).collect())
    left = [r for r in left if kept[r[:2]]]
    assert 20 < len(left) < 200
    want = Counter((d, size, crc, shard, slot) for (d, _, size, crc, shard, slot) in plain([(d, t, s) for d, t, _, s in left], 24).elements())
    out = corpus_pipeline.run(spark, folder)
    assert Counter((x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in out.collect()) == want


def test_stages_keep_columns_and_take_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for frame, at in ((docs.limit(0), folder), (docs, str(tmp_path))):
            out = stage(spark, frame, at)
            n = out.count()
            assert n == 0 if at == folder else n > 0
            if name != "sharding":
                assert out.columns == docs.columns
            if name in ("toxicity", "decontamination") and at != folder:
                assert n == docs.count()
